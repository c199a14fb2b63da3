"""Secret scans: candidate patterns over whole texts, and a random forest that removes false positives.

Candidates are found by one pattern for provider keys and assignments. Each gets the features that the
forest uses: length, character transitions and classes, coverage by dictionary words, the path it comes
from, and the words next to it. The forest is trained on labelled findings; its trees become one SQL
expression, so that scanning is a single narrow pass of DataFrame functions without Python workers.

Defined results: a null text counts as empty; a text without candidates has empty lists; a null path counts
as ''. Rows and ids may repeat and be null. Findings stand in text order. Existing columns of the output
names are replaced, all others pass through. ``redact`` replaces every occurrence of a found secret.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwire.llm.once import once

# Shapes of provider keys, then the names that stand before an assigned secret. Only formats of one
# fixed length have an upper bound. Repeated groups are possessive: Java's other ones recurse, and overflow on long values.
KEY_SHAPES = [
    r"AKIA[0-9A-Z]{16}",
    r"ASIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}+",
    r"xox[abpr]-[A-Za-z0-9-]{20,}+",
    r"sk_live_[A-Za-z0-9]{24,}+",
    r"AIza[0-9A-Za-z_-]{35}",
    r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+",
]
#: A private key up to its END line; without one, its header and the long runs that follow.
KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{20,}+)++)"
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret"

#: Characters before and after a candidate that count as its neighbourhood.
NEAR = 40
ASSIGN = rf"(?:{NAMES})[\"']?[ \t]*+[:=]{{1,2}}[ \t]*+"
#: A name may have more before it than the 40 characters that the match takes along.
ASSIGNED = rf"(?i:(?:\b[a-z0-9_.-]{{0,40}})?{ASSIGN})[\"']?(?!-----BEGIN )[A-Za-z0-9+/=_.~!@#$%^&*-]{{8,}}+"
CANDIDATE = rf"(?<![A-Za-z0-9])(?:{'|'.join(KEY_SHAPES)})(?![A-Za-z0-9])|{KEY_BLOCK}|{ASSIGNED}"
#: What stands before the value in a match.
BEFORE = rf"^(?i:[a-z0-9_.-]{{0,40}}{ASSIGN})[\"']?"

# Words that placeholders, examples and code are made of.
DICTIONARY = [
    "access", "api", "auth", "base", "bearer", "change", "changeme", "client", "config", "default", "demo", "dummy", "enter", "env", "example", "fake", "field", "file",
    "foo", "form", "get", "here", "hidden", "hunter", "input", "insert", "key", "local", "login", "mock", "name", "none", "null", "pass", "password", "placeholder",
    "private", "public", "redacted", "reset", "sample", "secret", "self", "set", "string", "super", "temp", "test", "the", "todo", "token", "type", "undefined", "user",
    "value", "your",
]
# Words near a candidate that speak for an example or for something that is no secret, and path parts of the same kind.
HARMLESS = "example|sample|placeholder|dummy|fake|mock|commit|checksum|sha1|sha256|md5|digest|revision|template"
HARMLESS_PATH = "test|spec|fixture|example|sample|mock|doc"

FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "changes", "distinct", "repeats", "dictionary", "longest_word", "vowel_runs",
    "key_shape", "quoted", "harmless_near", "name_near", "harmless_path", "call_like",
]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(value: Column, near: Column, path: Column) -> dict[str, Column]:
    """The features of a candidate by name: its value, the text around it, and the path of its text."""
    length = F.greatest(F.length(value), F.lit(1)).cast("double")
    lowered = F.lower(value)
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    uncovered = F.length(F.regexp_replace(lowered, f"(?:{words})", ""))
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])|(?<=[A-Z])(?=[a-z])"
    return {
        "length": length,
        "digits": _count(value, "[0-9]") / length,
        "uppers": _count(value, "[A-Z]") / length,
        "lowers": _count(value, "[a-z]") / length,
        "others": _count(value, "[^A-Za-z0-9]") / length,
        "changes": _count(value, change) / length,
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / F.least(length, F.lit(64.0)),
        "repeats": _count(value, r"(.)(?=\1)") / length,
        "dictionary": 1 - uncovered / length,
        "longest_word": F.coalesce(F.array_max(F.transform(F.split(lowered, "[^a-z]+"), lambda w: F.length(w))), F.lit(0)).cast("double"),
        "vowel_runs": _count(lowered, "[bcdfghjklmnpqrstvwxz][aeiouy]") / length,
        "key_shape": F.when(value.rlike(f"^(?:{'|'.join([*KEY_SHAPES, KEY_BLOCK])})$"), 1.0).otherwise(0.0),
        "quoted": F.when(near.rlike("[\"']"), 1.0).otherwise(0.0),
        "harmless_near": F.when(near.rlike(rf"(?i:\b(?:{HARMLESS})\b)(?!\.(?:com|net|org)\b)"), 1.0).otherwise(0.0),
        "name_near": F.when(near.rlike(f"(?i:{NAMES})"), 1.0).otherwise(0.0),
        "harmless_path": F.when(F.coalesce(path, F.lit("")).rlike(f"(?i:{HARMLESS_PATH})"), 1.0).otherwise(0.0),
        "call_like": F.when(value.rlike(r"^[a-z]++(?:[._][a-zA-Z]++)++$|\$|^\*+$|^<|\{"), 1.0).otherwise(0.0),
    }


def labelled_findings(spark: SparkSession, rows: int = 4000, start: int = 0) -> DataFrame:
    """(value, near, path, label): findings with their verdict, made from seeded hashes.

    Half are secrets: random keys in the shapes of providers, hexadecimal, base64 or mixed values. Half are
    false positives: placeholders, names and calls of code, masked values, and random values beside words
    that make them checksums, commits or examples. Some of both are long, up to 16,000 characters: hexadecimal
    and base64 runs, tokens and private keys, and repeated placeholders. ``rows`` bounds the training set; findings of ids from another ``start`` are new ones.
    """
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    noise = lambda k: F.concat(F.sha2(F.concat("id", F.lit(f"a{k}")), 256), F.sha2(F.concat("id", F.lit(f"b{k}")), 256))

    def spelled(letters: str, k: int, length: Column) -> Column:
        """Letters picked by the bytes of a hash."""
        picks = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.substring(F.lit(letters), F.pmod(F.xxhash64("id", F.lit(k), i), F.lit(len(letters))).cast("int") + 1, F.lit(1)))
        return F.array_join(picks, "")

    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda k, *of: F.get(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in of)), draw(k, len(of)))
    word = lambda k: F.get(F.array(*map(F.lit, DICTIONARY)), draw(k, len(DICTIONARY)))
    hexed = F.substring(noise(1), F.lit(1), draw(2, 33) + 12)
    mixed = spelled(upper + lower + digits, 3, draw(4, 29) + 12)
    secret = pick(
        5,
        F.concat(F.lit("AKIA"), spelled(upper + "234567", 6, F.lit(16))),
        F.concat(F.lit("ghp_"), spelled(upper + lower + digits, 7, F.lit(36))),
        hexed,
        hexed,
        mixed,
        spelled(upper + lower + digits + "+/", 8, draw(9, 25) + 20),
        spelled(lower + digits + "!@#%_", 10, draw(11, 13) + 10),
    )
    harmless = pick(
        12,
        F.concat_ws("_", word(13), word(14), word(15)),
        F.concat_ws("-", word(13), word(14)),
        F.concat(word(13), word(14), draw(16, 1000).cast("string")),
        F.concat_ws(".", word(13), word(14), word(15)),
        F.concat(F.lit("$"), F.upper(F.concat_ws("_", word(13), word(14)))),
        F.repeat(pick(17, "x", "*", "0", "A", "1"), draw(18, 20) + 8),
        F.concat(F.lit("AKIA"), pick(19, "IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "1234567890ABCDEF")),
        F.substring(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), F.lit(1), draw(20, 20) + 10),
        hexed,
        mixed,
    )
    size = F.floor(F.pow(F.lit(2.0), 6 + draw(29, 800) / 100)).cast("int")
    long_hex = F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(size / 64).cast("int")), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), ""), F.lit(1), size)
    long_base64 = F.regexp_replace(F.base64(F.unhex(F.concat(long_hex, F.when(size % 2 == 1, "0").otherwise("")))), r"\s", "")
    url = F.translate(F.regexp_replace(long_base64, "=", ""), "+/", "-_")
    part = F.concat(F.lit("eyJ"), F.left(url, F.lit(20)))
    block = lambda body: F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), body, F.lit("\n-----END PRIVATE KEY-----"))
    long_secret = [long_hex, long_base64, F.concat_ws(".", part, url, F.left(url, F.lit(43))), F.concat(F.lit("sk_live_"), F.regexp_replace(url, "[-_]", "")), block(long_base64)]
    filler = [F.repeat(pick(17, "x", "*", "0", "A", "1"), size), F.repeat(F.concat(word(13), F.lit("_")), F.ceil(size / 8).cast("int")), F.repeat(F.concat(word(13), F.lit("."), word(14), F.lit(".")), F.ceil(size / 12).cast("int"))]
    long_harmless = [*filler, block(F.repeat(F.lit("x"), size)), block(filler[1])]
    choose = lambda k, of: reduce(lambda rest, x: F.when(draw(k, len(of)) == x[0], x[1]).otherwise(rest), enumerate(of[1:], 1), of[0])
    is_long = draw(30, 8) == 0
    name = pick(21, "password=", "token = \"", "secret: ", "api_key='", "client_secret = ", "")
    about = F.concat(F.concat_ws(" ", spelled(lower, 22, draw(23, 8) + 2), spelled(lower, 24, draw(25, 8) + 2)), F.lit(" "))
    bad = F.concat(pick(26, "commit ", "checksum ", "example ", "sample ", "sha256 digest ", "placeholder "), name)
    label = F.pmod("id", F.lit(2)).cast("double")
    random_value = ~is_long & (draw(12, 10) >= 8)
    secret, harmless = F.when(is_long, choose(31, long_secret)).otherwise(secret), F.when(is_long, choose(31, long_harmless)).otherwise(harmless)
    return spark.range(start, start + rows, 1, 4).select(
        F.when(label == 1, secret).otherwise(harmless).alias("value"),
        F.concat(about, F.when((label == 0) & random_value, bad).when((label == 0) & (draw(27, 3) == 0), bad).otherwise(name)).alias("near"),
        F.when(label == 1, pick(28, "src/app.py", "conf/prod.yaml", "src3", "docs/setup.md", "")).otherwise(pick(28, "tests/test_api.py", "examples/demo.py", "src/app.py", "src3", "")).alias("path"),
        label.alias("label"),
    )


def forest_sql(findings: DataFrame, trees: int = 20, depth: int = 6, seed: int = 7) -> str:
    """Train on (value, near, path, label); the share of secrets as SQL over fields of ``f``.

    Training rows are put into one ordered partition first, so that equal findings give the same forest.
    """
    named = features(F.col("value"), F.col("near"), F.col("path"))
    table = findings.select(*(c.alias(n) for n, c in named.items()), "label").orderBy(*FEATURES, "label").coalesce(1)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5, maxBins=64).fit(ready)

    def case(node) -> str:
        if node.subtreeDepth() == 0:
            return f"{node.impurityStats().prob(1.0):.6f}D"
        split = node.split()
        return f"IF(f.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D, {case(node.leftChild())}, {case(node.rightChild())})"

    roots = [case(tree._call_java("rootNode")) for tree in model.trees]
    return f"(({' + '.join(roots)}) / {len(roots)}D)"


def _sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it, by blocks of about the square root of their count."""

    def running(part: Column, start: Column) -> Column:
        """``start``, then the sums with each number of the part."""
        return F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def summed(c: Column) -> Column:
        width, count = c["width"], F.size(c["numbers"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(count, F.lit(1)) - 1) / width).cast("int")), lambda k: F.slice(c["numbers"], k * width + 1, width))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        placed = lambda bound: F.flatten(F.transform(bound["blocks"], lambda b, k: F.slice(running(b, F.get(bound["starts"], k)), F.lit(1), F.size(b))))
        return once(F.struct(blocks.alias("blocks"), running(totals, F.lit(0)).alias("starts")), placed)

    return once(F.struct(numbers.alias("numbers"), F.ceil(F.sqrt(F.greatest(F.size(numbers), F.lit(1)))).cast("int").alias("width")), summed)


def candidates(text: Column) -> Column:
    """array<struct<start, value, near>> of the whole text, in order.

    The text is cut at its matches: the pieces between them give every match its place. The matches, the pieces
    and the places are computed once for a text, so that the time grows with the text, not with its square.
    """
    whole = F.coalesce(text, F.lit(""))
    cut = F.struct(F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(whole, CANDIDATE, -1).alias("gaps"))

    def one(match: Column, before: Column, after: Column, start: Column) -> Column:
        value = F.regexp_replace(match, BEFORE, "")

        def placed(v: Column) -> Column:
            named = F.length(match) - F.length(v)
            near = F.concat(F.right(before, F.lit(NEAR)), F.substring(match, F.lit(1), named), F.lit(" "), F.left(after, F.lit(NEAR)))
            return F.struct((start + F.length(before) + named).alias("start"), v.alias("value"), near.alias("near"))

        return once(value, placed)

    def listed(c: Column) -> Column:
        lengths = F.zip_with(c["found"], F.slice(c["gaps"], F.lit(1), F.size(c["found"])), lambda m, g: F.length(m) + F.length(g))
        after = lambda i: F.coalesce(F.get(c["gaps"], i + 1), F.lit(""))
        return once(_sums_before(lengths), lambda starts: F.transform(c["found"], lambda m, i: one(m, F.get(c["gaps"], i), after(i), F.get(starts, i))))

    return F.when(whole.rlike(CANDIDATE), once(cut, listed)).otherwise(F.array().cast("array<struct<start:int,value:string,near:string>>"))


def scan(docs: DataFrame, forest: str, text: str = "text", path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """Add ``secrets`` and ``rejected``: arrays of (start, length, value, score), ``start`` from 0 in code points."""
    where = F.coalesce(F.col(path), F.lit("")) if path else F.lit("")
    named = lambda c: F.struct(c["start"].alias("start"), c["value"].alias("value"), *(v.alias(n) for n, v in features(c["value"], c["near"], where).items()))
    keep = [c for c in docs.columns if c not in ("secrets", "rejected")]
    rows = docs.select(*keep, candidates(F.col(text)).alias("__found"))
    rows = rows.withColumn("__found", F.transform("__found", named))
    rows = rows.withColumn("__found", F.expr(f"transform(__found, f -> named_struct('start', f.start, 'length', length(f.value), 'value', f.value, 'score', {forest}))"))
    verdict = lambda good: F.filter("__found", lambda f: (f["score"] >= threshold) if good else (f["score"] < threshold))
    return rows.select(*keep, verdict(True).alias("secrets"), verdict(False).alias("rejected"))


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every occurrence of a found secret in ``text``, longer ones first; null texts stay null."""
    values = F.array_sort(F.array_distinct(F.transform("secrets", lambda s: F.struct((-s["length"]).alias("n"), s["value"].alias("v")))))
    return scanned.withColumn(text, F.aggregate(values, F.col(text), lambda t, s: F.replace(t, s["v"], F.lit(mark))))
