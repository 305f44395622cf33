"""Secret scans: candidates by pattern, false positives removed by a random forest, all in DataFrame expressions.

Candidates are values that a credential's name is assigned, keys with a known beginning, PEM private keys, and long
mixed tokens, each of any length. A quoted value goes up to its quote. Each
gets features of its length, its character transitions, how much of it dictionary words cover, the path it was found
in and the neighbouring words. A random forest is trained on labelled findings and then written out as column
expressions, so that scanning is one projection over the documents.

Labelled findings are a table (text, source, label) of which each text has one candidate. labelled_findings() makes
a table of them by rule; a user's own can be given instead.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NEAR = 60  # characters on either side that count as neighbouring words
VALUE = r"[A-Za-z0-9+/_=.\-]"
#: Names of credentials, and the beginnings and sizes of keys that have such.
NAMES = r"(?:pass(?:word|wd)?|pwd|secret|token|credential|auth|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret)"
PEM = r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
KNOWN = rf"AKIA[A-Z0-9]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|xox[abprs]-[A-Za-z0-9-]{{10,}}+|sk_(?:live|test)_[A-Za-z0-9]{{16,}}+|AIza[A-Za-z0-9_-]{{35}}|eyJ[A-Za-z0-9_-]{{8,}}+(?:\.[A-Za-z0-9_-]{{8,}}+){{2,4}}|{PEM}"
#: A quoted value goes up to its quote, unless another key is in it; a bare one to white space or what ends a value in code, URLs and connection strings.
QUOTED = "|".join(rf"""{q}(?![^{q}\r\n]*(?:[ \t=:](?:{KNOWN})(?![A-Za-z0-9])|(?i:{NAMES})[=:]))(?:[^{q}\\\r\n]|\\[^\r\n]){{6,}}+(?={q})""" for q in "\"'")
BARE = r"""(?:[^\x00-\x20\x7f\u00a0\u3000"'`,;()\[\]{}<>|\\&:]|&(?![\w.-]{1,64}=)|:(?!//)){6,}+"""
CANDIDATE = (
    rf"""(?i:{NAMES}\b["']?[ \t]*+(?:=|:)[ \t]*+)(?:["']?{PEM}|{QUOTED}|["']?{BARE})"""
    rf"""|\b(?:{KNOWN})(?![A-Za-z0-9])|{PEM}"""
    rf"""|(?<![A-Za-z0-9+/_=-])(?=[a-zA-Z+/_-]*+[0-9])(?=[0-9+/_-]*+[a-zA-Z])[A-Za-z0-9+/_-]{{20,}}+={{0,2}}(?![A-Za-z0-9+/_=-])"""
)
#: A cheap test that every text with a candidate passes: a name and = or :, a known beginning, or a long run.
MAYBE = rf"(?i:{NAMES})|AKIA|AIza|eyJ|PRIVATE KEY|{VALUE}{{14}}"
WORDS = "password secret token admin root user username login example sample test dummy fake change changeme default your here insert replace placeholder redacted hidden none null true false string value name key api access private public client server config setting option enable field input form label the and for this that with from some hello world foo bar baz qwerty abc letmein welcome get set account email reset hash session cookie header field type path file local host data".split()  # fixed values
FAKE = r"(?i)\b(?:example|sample|dummy|fake|placeholder|test|demo|template|todo|redacted|not a real)\b"
DIGEST = r"(?i)\b(?:commit|sha-?\d*|md5|checksum|digest|revision|uuid|guid|integrity|etag|blob|tree|parent)\b"
NAMED = rf"(?i){NAMES}"
PATHS = r"(?i)(?:^|[/_.-])(?:tests?|examples?|docs?|samples?|fixtures?|mock\w*|readme)(?:$|[/_.-])"
COMMON_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()  # fixed values

FEATURES = ["f_length", "f_changes", "f_pairs", "f_entropy", "f_distinct", "f_digits", "f_hex", "f_words", "f_repeat", "f_path", "f_named", "f_fake", "f_digest", "f_known", "f_assigned"]


def candidates(docs: DataFrame, keys: list[str], text: str, source: str | None) -> DataFrame:
    """keys, tag of the row, ordinal, start, hit, before, after, source of each candidate."""
    body = F.col(text).cast("string")
    rows = docs.select(*(F.col(k).alias(k) for k in keys), (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source"), body.alias("body"), F.monotonically_increasing_id().alias("tag"))
    rows = rows.filter(F.col("body").rlike(MAYBE) & F.col("body").rlike(CANDIDATE))
    cut = rows.select(*keys, "tag", "source", F.regexp_extract_all("body", F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split("body", CANDIDATE, -1).alias("gaps"))
    ends = F.transform("gaps", lambda g: F.struct(F.length(g).alias("size"), F.right(g, F.lit(NEAR)).alias("right"), F.left(g, F.lit(NEAR)).alias("left")))
    cut = cut.select(*keys, "tag", "source", "hits", ends.alias("ends"))
    each = cut.select(*keys, "tag", "source", F.posexplode(F.arrays_zip(F.col("hits").alias("hit"), F.slice("ends", 1, F.size("hits")).alias("before"), F.slice("ends", 2, F.size("hits")).alias("after"))).alias("ordinal", "x"))
    sizes = F.sum(F.col("x.before.size") + F.length("x.hit")).over(W.partitionBy("tag").orderBy("ordinal"))
    return each.select(*keys, "source", "ordinal", (sizes - F.length("x.hit")).cast("long").alias("start"), F.col("x.hit").alias("hit"), F.col("x.before.right").alias("before"), F.col("x.after.left").alias("after"))


def with_features(found: DataFrame) -> DataFrame:
    """Adds rule, value and the columns FEATURES."""
    assigned = F.col("hit").rlike(rf"""^(?i:[\w-]*{NAMES}["']?[ \t]*[=:])""")
    value = F.when(assigned, F.regexp_extract("hit", r"""[=:][ \t]*["']?((?s:.*))$""", 1)).otherwise(F.col("hit"))
    known = F.col("value").rlike(rf"^(?:{KNOWN})$")
    found = found.withColumn("value", value).withColumn("size", F.greatest(F.length("value"), F.lit(1)))
    v, size = F.col("value"), F.col("size")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / size
    pairs = F.regexp_count(F.lower(v), F.lit("(?=" + "|".join(COMMON_PAIRS) + ")"))
    each = F.array_distinct(F.regexp_extract_all(v, F.lit("(?s)."), F.lit(0)))
    entropy = F.aggregate(F.transform(each, lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))) / size), F.lit(0.0), lambda total, p: total - p * F.log2(p))
    around = F.concat_ws(" ", "before", F.when(assigned, F.regexp_extract("hit", r"^([^=:]*)", 1)), "after")
    flag = lambda c: c.cast("double")
    return found.withColumns(
        {
            "rule": F.when(known, "known").when(assigned, "assigned").otherwise("token"),
            "f_length": flag(F.length(v)),
            "f_changes": flag(share(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]")),
            "f_pairs": flag(pairs / size),
            "f_entropy": entropy,
            "f_distinct": flag(F.size(each) / size),
            "f_digits": flag(share("[0-9]")),
            "f_hex": flag(v.rlike("^[0-9a-fA-F]+$")),
            "f_words": flag((F.length(v) - F.length(F.regexp_replace(F.lower(v), "(?:" + "|".join(sorted(WORDS, key=len, reverse=True)) + ")", ""))) / size),
            "f_repeat": flag(share(r"(.)\1")),
            "f_path": flag(F.coalesce(F.col("source").rlike(PATHS), F.lit(False))),
            "f_named": flag(around.rlike(NAMED)),
            "f_fake": flag(F.concat_ws(" ", around, "value").rlike(FAKE)),
            "f_digest": flag(around.rlike(DIGEST)),
            "f_known": flag(known),
            "f_assigned": flag(assigned),
        }
    )


def labelled_findings(spark: SparkSession, n: int = 2400, first: int = 0) -> DataFrame:
    """text, source, label: n findings made by rule, half of them secrets; each id from first on gives the same row always."""
    i = F.col("id")
    salted = lambda s: F.sha2(F.concat(i.cast("string"), F.lit(s)), 256)
    number = lambda s, low, high: (F.pmod(F.xxhash64(i, F.lit(s)), F.lit(high - low + 1)) + low).cast("int")
    pick = lambda s, options: F.element_at(F.array(*map(F.lit, options)), number(s, 1, len(options)))
    base64 = F.regexp_replace(F.base64(F.unhex(salted("b"))), "=", "")
    upper = F.upper(F.translate(F.substring(base64, 1, 16), "+/", "XY"))
    alnum = F.translate(F.concat(base64, F.regexp_replace(F.base64(F.unhex(salted("c"))), "=", "")), "+/", "XY")
    name = pick("n", ["password", "token", "secret", "api_key", "passwd", "access_key", "auth", "client_secret"])
    mark = pick("m", ["=", " = ", ": ", ":"])
    quote = pick("q", ["", '"'])
    assign = lambda x: F.concat(name, mark, quote, x, quote)
    word = lambda s: pick(s, WORDS)
    real = [
        assign(F.substring(salted("h"), F.lit(1), number("l", 12, 64))),
        F.concat(F.lit("AKIA"), upper),
        assign(F.substring(alnum, F.lit(1), number("l", 12, 60))),
        F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)),
        assign(base64),
        F.concat(F.lit("sk_live_"), F.substring(alnum, 1, 24)),
    ]
    false = [
        assign(F.concat(word("a"), pick("s", ["_", "-", "", "."]), word("b"), number("d", 1, 999).cast("string"))),
        F.concat(pick("g", ["commit ", "sha256 ", "md5 ", "checksum ", "revision "]), F.substring(salted("g"), 1, 40)),
        F.concat(F.lit("uuid "), F.substring(salted("u"), 1, 8), F.lit("-"), F.substring(salted("u"), 9, 4), F.lit("-"), F.substring(salted("u"), 13, 12)),
        assign(F.repeat(pick("r", ["x", "0", "*", "abc", "12"]).cast("string"), number("k", 8, 14))),
        F.concat(word("a"), F.lit("_"), word("b"), F.lit("_"), word("c"), F.lit("_"), word("e"), number("d", 10, 99).cast("string"), F.lit("_path_file")),
        F.concat(F.lit("an example, not a real key: "), assign(F.substring(alnum, 1, 20))),
    ]
    kind, secret = F.pmod(F.xxhash64(i, F.lit("kind")), F.lit(6)), i % 2 == 1
    body = F.lit(None).cast("string")
    for k in range(6):
        body = F.when(secret & (kind == k), real[k]).when(~secret & (kind == k), false[k]).otherwise(body)
    text = F.concat(word("w"), F.lit(" "), word("x"), F.lit(" "), body, F.lit(" "), word("y"), F.lit(" "), word("z"))
    source = F.when(~secret & (number("p", 1, 3) == 1), "tests/fixtures/a.py").otherwise(pick("o", ["src/main.py", "config.yml", "src4", "notes.txt"]))
    return spark.range(first, first + n).select(text.alias("text"), source.alias("source"), secret.cast("int").alias("label"))


#: A tree: the share of secrets at a leaf, or (feature, threshold, tree up to it, tree beyond it).
Tree = float | tuple[int, float, "Tree", "Tree"]


def train(labelled: DataFrame, trees: int = 15, depth: int = 6, seed: int = 7) -> list[Tree]:
    """A random forest over FEATURES. labelled: text, source, label; a user can keep the trees and pass them to scan_secrets()."""
    rows = with_features(candidates(labelled, ["label"], "text", "source").filter("ordinal = 0")).select("label", *FEATURES)
    made = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(rows).withColumn("label", F.col("label").cast("double"))
    model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(made.repartition(1))

    def plain(node) -> Tree:
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return float(stats[1] / (sum(stats) or 1))
        split = node.split()
        return split.featureIndex(), float(split.threshold()), plain(node.leftChild()), plain(node.rightChild())

    return [plain(t._call_java("rootNode")) for t in model.trees]


def score_of(forest: list[Tree]) -> Column:
    """The forest's probability of a secret, as an expression over FEATURES."""

    def expression(tree: Tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        feature, threshold, low, high = tree
        return F.when(F.col(FEATURES[feature]) <= threshold, expression(low)).otherwise(expression(high))

    each = [expression(t) for t in forest]
    return sum(each[1:], each[0]) / len(each)


FITTED: dict[str, list[Tree]] = {}  # on labelled_findings(), by Spark application


def fitted(spark: SparkSession) -> list[Tree]:
    """The forest of labelled_findings(), which an application fits once."""
    key = spark.sparkContext.applicationId
    if key not in FITTED:
        FITTED[key] = train(labelled_findings(spark))
    return FITTED[key]


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", forest: list[Tree] | None = None, least: float = 0.5) -> DataFrame:
    """One row per finding with a score of at least least: doc_id, ordinal, start, rule, n_chars, value_sha256, score.

    Whole texts. ordinal counts a text's candidates from 0, start is the candidate's first character, from 0: of an
    assigned one the credential's name. Secrets themselves aren't returned, only their SHA-256. Null and empty texts
    have no findings; repeated rows give their findings each; an empty table gives none; without a source column, or
    where it is null, the path says nothing; other columns are not read. forest: train()'s, of a user's own findings.
    """
    path = F.col(source) if source in docs.columns else F.lit(None)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), path.cast("string").alias("source"))
    score = score_of(forest or fitted(docs.sparkSession))
    found = with_features(candidates(rows, ["doc_id"], "text", "source")).withColumn("score", F.round(score, 6))
    return found.filter(F.col("score") >= least).select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), "start", "rule", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score")
