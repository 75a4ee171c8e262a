"""Secret scans with a random forest that removes false positives, in DataFrame functions only.

Candidates are long runs of token characters and quoted values after a secret's usual names. Features of
a candidate: its length and characters, how likely its letters' transitions are in the texts, how much of
it the texts' words cover, the path it lies under and the words around it. Transitions and words are learnt
from all texts; the forest is trained from labelled findings.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Runs of 16 and more token characters, which end before NAME=value, and values of 8 and more after a name and = or :.
#: The short look-arounds come first, as they rule out most places cheaply.
RUN = r"(?<![A-Za-z0-9+/_=.\-])(?=[A-Za-z0-9+/_=.\-]{16})(?:(?!(?i:password|passwd|pwd|secret|token|api[_-]?key)=[^\s\"'<>]{8})[A-Za-z0-9+/_=.\-]){16,}+"
NAMED = r"(?<=[:=\"'\s])(?<=[:=]\s{0,2}[\"']{0,1})(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']{0,1}\s{0,2}[:=]\s{0,2}[\"']{0,1})[^\s\"'<>]{8,}+"
CANDIDATE = f"{NAMED}|{RUN}"
#: What every candidate's text has; cheap to look for.
TRACE = r"(?<![A-Za-z0-9+/_=.\-])[A-Za-z0-9+/_=.\-]{16}|(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']{0,1}\s{0,2}[:=]"
CONTEXT = 40

#: Words that mark secrets, fingerprints and placeholders; words of code for made findings; common letter pairs of English; path parts.
SECRET_WORDS = ["api", "apikey", "auth", "bearer", "credential", "credentials", "key", "passwd", "password", "private", "pwd", "secret", "token"]
HASH_WORDS = ["checksum", "commit", "digest", "etag", "fingerprint", "guid", "hash", "integrity", "md5", "revision", "sha1", "sha256", "sha512", "uuid"]
SAMPLE_WORDS = ["changeme", "demo", "dummy", "example", "fake", "foo", "mock", "placeholder", "replace", "sample", "test", "todo", "xxxx", "your"]
CODE_WORDS = ["access", "account", "admin", "application", "button", "cache", "client", "config", "content", "control", "count", "data", "date", "default", "demo", "document", "example", "field", "file", "fixture", "format", "group", "handler", "here", "icon", "image", "index", "item", "key", "large", "list", "local", "manager", "message", "module", "name", "number", "object", "option", "order", "page", "password", "path", "placeholder", "request", "response", "sample", "secret", "server", "service", "small", "source", "string", "style", "table", "test", "text", "token", "type", "update", "user", "value", "version", "view", "window", "your"]
PAIRS = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur"]
SAMPLE_PATHS = ["demo", "doc", "docs", "example", "examples", "fixture", "fixtures", "mock", "sample", "samples", "spec", "test", "tests", "vendor"]

FEATURES = ["length", "class_changes", "transitions", "distinct_share", "digit_share", "upper_share", "hex_only", "uuid_form", "dotted_or_path", "dictionary_share", "longest_repeat", "sample_path", "secret_left", "assigned", "hash_left", "sample_near"]
_LETTERS, _WORD_SIZES = 26, range(4, 13)


@dataclass(frozen=True)
class Statistics:
    """What the features know of the texts: natural logarithms of P(next letter | letter) for a-z, row by row; words of the dictionary; words for made findings, half of them outside the dictionary."""

    transitions: tuple[float, ...]
    dictionary: tuple[str, ...]
    others: tuple[str, ...]


def learn(docs: DataFrame, text_col: str = "text", most_words: int = 2000) -> Statistics:
    """Statistics of all different texts, each whole and counted once; the driver gets 676 counts and most_words words at most.

    Each of PAIRS counts as seen 20 times before any text; without texts no word is known. The words of CODE_WORDS are never in the dictionary.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct()
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = cut(words.where(F.length("word") > 1))
    steps = words.select("n", F.explode(F.regexp_extract_all("word", F.lit("(?=([a-z]{2}))"), F.lit(1))).alias("step"))
    counts = {r["step"]: r["n"] for r in steps.groupBy("step").agg(F.sum("n").alias("n")).collect()}  # 676 at most
    letters = [chr(97 + k) for k in range(_LETTERS)]
    seen = {a + b: counts.get(a + b, 0) + 20 * (a + b in PAIRS) + 0.5 for a in letters for b in letters}
    table = tuple(math.log(seen[a + b] / sum(seen[a + c] for c in letters)) for a in letters for b in letters)
    common = words.where(F.length("word").between(_WORD_SIZES[0], _WORD_SIZES[-1]) & (F.col("n") > 1) & ~F.col("word").isin(CODE_WORDS))
    common = [r["word"] for r in common.orderBy(F.desc("n"), "word").limit(most_words).collect()]
    return Statistics(table, tuple(w for k, w in enumerate(common) if k % 14), tuple(common[::7]))


def _words(items: list[str]) -> str:
    return "|".join(items)


def _transitions(known: Statistics) -> Column:
    """The mean logarithm of the transitions between the candidate's neighbouring letters; -6 where it has none. As SQL, since lists of literals are slow to build one by one."""
    table = ", ".join(f"{x!r}D" for x in known.transitions)
    codes = "slice(transform(split(lower(candidate), ''), c -> ascii(c) - 97), 1, char_length(candidate))"
    both = f"a between 0 and {_LETTERS - 1} and b between 0 and {_LETTERS - 1}"
    steps = f"filter(zip_with(slice({codes}, 1, char_length(candidate) - 1), slice({codes}, 2, char_length(candidate)), (a, b) -> if({both}, element_at(array({table}), a * {_LETTERS} + b + 1), null)), x -> x is not null)"
    return F.coalesce(F.expr(f"aggregate({steps}, struct(0D as t, 0 as n), (s, x) -> struct(s.t + x as t, s.n + 1 as n), s -> if(s.n > 0, s.t / s.n, null))"), F.lit(-6.0))


def _dictionary_share(known: Statistics) -> Column:
    """The share of characters that words of the dictionary cover: from left to right, what each place's longest word adds.

    The candidate is split once; each place then looks at the next few characters only.
    """
    if not known.dictionary:
        return F.lit(0.0)
    words = ", ".join(f"'{w}'" for w in known.dictionary)
    sizes = f"filter(sequence({_WORD_SIZES[0]}, {_WORD_SIZES[-1]}), n -> i + n - 1 <= size(s) and array_join(slice(s, i, n), '') in ({words}))"
    longest = f"transform(sequence(1, size(s)), i -> if(s[i - 1] between 'a' and 'z', coalesce(array_max({sizes}), 0), 0))"
    covered = f"aggregate({longest}, struct(0 as i, 0 as reach, 0 as covered), (t, n) -> struct(t.i + 1 as i, greatest(t.reach, t.i + n) as reach, t.covered + greatest(0, t.i + n - greatest(t.reach, t.i)) as covered), t -> t.covered)"
    split = "slice(split(lower(candidate), ''), 1, char_length(candidate))"
    return F.expr(f"transform(array({split}), s -> {covered})[0] / char_length(candidate)")


def features(df: DataFrame, known: Statistics) -> DataFrame:
    """Adds the feature columns to rows with candidate, left, right and path."""
    c, size = F.col("candidate"), F.char_length("candidate")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]", "."), "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1")
    near = lambda words, text: F.lower(text).rlike(rf"(?<![a-z])(?:{_words(words)})").cast("double")
    lower = F.lower(c)
    share = lambda pattern: F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0)) / size
    made = {
        "length": size.cast("double"),
        "class_changes": (F.regexp_count(classes, F.lit("a+|B+|1+|[.]+")) - 1) / size,
        "transitions": _transitions(known),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / size,
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "hex_only": c.rlike("^[0-9a-fA-F]+$").cast("double"),
        "uuid_form": lower.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$").cast("double"),
        "dotted_or_path": share("[./]"),
        "dictionary_share": _dictionary_share(known),
        "longest_repeat": c.rlike(r"(.)\1{4}").cast("double"),
        "sample_path": F.coalesce(F.lower("path").rlike(rf"(?:^|[/._-])(?:{_words(SAMPLE_PATHS)})(?:[/._-]|$)"), F.lit(False)).cast("double"),
        "secret_left": near(SECRET_WORDS, F.col("left")),
        "assigned": F.col("left").rlike(r"[:=]\s*[\"']?$").cast("double"),
        "hash_left": near(HASH_WORDS, F.col("left")),
        "sample_near": near(SAMPLE_WORDS, F.concat("left", F.lit(" "), c, F.lit(" "), "right")),
    }
    return df.withColumns({k: made[k].cast("double") for k in FEATURES})


def labelled_findings(spark: SparkSession, n: int = 6000, words: Sequence[str] = CODE_WORDS) -> DataFrame:
    """Labelled findings (candidate, left, right, path, label) from rules: eight kinds of secrets and seventeen of false positives, with text from hashes of row numbers and the given words."""
    rows = spark.range(0, n, 1, 4).withColumn("h", F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 256))
    h = F.col("h")
    mixed = F.regexp_replace(F.base64(F.unhex(F.concat(h, F.sha2(h, 256)))), "[+/=]", "Q")
    pick = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.xxhash64(h, F.lit(at)), F.lit(len(items))) + 1).cast("int"))
    sub = lambda text, size: F.substring(text, 1, size)
    name = lambda: pick(["token", "api_key", "secret", "password", "auth_token", "client_secret", "TOKEN"], 1)
    assign = lambda: F.concat(name(), pick([' = "', ": ", '="', ": '", " := \"", "="], 2))
    among = F.split(F.lit(" ".join(words)), " ")  # one literal: long lists of them are slow to plan
    word = lambda at: F.element_at(among, (F.pmod(F.xxhash64(h, F.lit(at)), F.lit(len(words))) + 1).cast("int"))
    number = F.lpad(F.pmod(F.xxhash64(h, F.lit(9)), F.lit(10000)).cast("string"), 4, "0")
    letters = F.translate(mixed, "0123456789", "qWzKxVjYpB")
    prose = F.when(number < "5000", F.concat(*[word(k) for k in range(20, 24)])).otherwise(F.concat(*[pick(PAIRS, k) for k in range(24, 33)]))
    between = pick(["/", ".", "-"], 18)
    kinds = [
        (1, sub(h, 40), assign()), (1, sub(mixed, 32), assign()), (1, F.concat(F.lit("AKIA"), sub(F.upper(mixed), 16)), pick(["key ", "", "aws = "], 3)),
        (1, F.concat(F.lit("ghp_"), sub(mixed, 36)), pick(["", "token ", "auth: "], 3)), (1, sub(F.concat(F.substring(mixed, 7, 9), F.lit("!"), mixed), 13), F.concat(F.lit("password"), pick([' = "', ": "], 2))), (1, h, assign()),
        (0, h, pick(["sha256:", "sha256: ", "checksum = ", "integrity ", "digest: "], 3)), (0, sub(h, 40), pick(["commit ", "revision ", "hash: ", "etag = \""], 3)),
        (0, F.concat(sub(h, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 22, 12)), pick(["uuid = ", "id: ", "", "guid: "], 3)),
        (0, F.concat(F.lit("your_"), word(4), F.lit("_"), word(5), F.lit("_here"), number), assign()), (0, F.concat(word(4), F.lit("_"), word(5), F.lit("_"), word(6), number), pick(["", "def ", "call "], 3)),
        (0, F.concat(word(4), F.lit("/"), word(5), F.lit("/"), word(6), F.lit("-"), number, F.lit(".png")), pick(["src=\"", "see ", "from "], 3)), (0, F.repeat(number, 5), pick(["", "number ", "order "], 3)),
        (0, F.concat(F.lit("test_"), word(4), F.lit("_value_"), number), assign()), (0, F.concat(F.lit("xxxxxxxxxxxx"), number), assign()),
        (1, F.concat(F.initcap(word(4)), F.initcap(word(5)), pick(["!", "#", "&", "-", "."], 13), F.initcap(word(6))), F.concat(pick(["password", "passwd", "pwd", "DB_PASSWORD"], 14), pick([' = "', ": ", "=", '="'], 2))), (1, F.when(number < "5000", sub(letters, 32)).otherwise(sub(letters, 20)), assign()),
        (0, F.concat(prose, pick(["", ".", "ly"], 15)), pick(["", "and ", "see: ", "the ", "token ", "password "], 3)), (0, F.concat(F.initcap(prose), pick(["", "."], 15)), pick(["", "und ", "die ", ". "], 3)), (0, F.concat(F.upper(prose), pick(["", "", "."], 15)), pick(["", "THE ", "LA "], 3)),
        (0, F.concat(F.upper(prose), F.lit(".")), pick(["", "THE ", ". ", "DIE "], 3)), (0, F.concat(F.initcap(prose), pick([",", ".", "-"], 15), word(19)), pick(["", "und ", ". "], 3)),
        (0, F.concat(word(4), F.lit("_"), word(5), F.lit("_"), word(6)), pick(["", "def ", "call ", "= "], 3)), (0, F.concat(word(4), between, word(5), between, word(6), between, word(16)), pick(["", "see ", "from ", 'src="'], 3)),
        (0, F.when(number < "3000", F.concat(F.lit("your_"), word(4), F.lit("_"), word(5), F.lit("_here"))).when(number < "6000", F.concat(word(4), word(5))).otherwise(F.repeat(pick(["-", "=", "_", ".", "x"], 17), 20)), F.when(number < "6000", assign()).otherwise("")),
    ]
    chosen = F.element_at(F.array(*[F.struct(F.lit(y).alias("label"), c.alias("candidate"), F.concat(word(7), F.lit(" "), word(8), F.lit(" "), left).alias("left")) for y, c, left in kinds]), (F.col("id") % len(kinds) + 1).cast("int"))
    out = rows.select(chosen.alias("x"), pick(["src0", "src7", "src/main.py", "config/app.yml", "lib/auth.js", "deploy/values.yaml"], 10).alias("real"), pick(["tests/fixtures/a.py", "docs/setup.md", "src/main.py", "package.lock", "src3"], 11).alias("other"), word(12).alias("w"))
    return out.select("x.candidate", "x.left", F.concat(F.lit('" '), "w").alias("right"), F.when(F.col("x.label") == 1, F.col("real")).otherwise(F.col("other")).alias("path"), F.col("x.label").cast("double").alias("label"))


def train(labelled: DataFrame, known: Statistics, trees: int = 20, depth: int = 7, seed: int = 11) -> PipelineModel:
    """A forest on labelled findings (candidate, left, right, path, label 0 or 1); the labelled table is a bounded one, such as 6,000 rows."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    rows = cut(assembler.transform(features(labelled, known)).select("features", "label"))
    return PipelineModel([assembler, forest.fit(rows)])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Rows (id, path, key, k, start, candidate, left, right) of every candidate of every whole text; start counts characters and k candidates from 0; key is that of text and path."""
    text = F.col(text_col)
    found = docs.where(text.rlike(TRACE)).select(F.col(id_col).cast("long").alias("id"), F.col(path_col).cast("string").alias("path"), _key(text_col, path_col).alias("key"), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("c"), F.split(text, CANDIDATE, -1).alias("s"))
    zipped = F.arrays_zip("c", "s", F.slice("s", F.lit(2), F.size("s")).alias("n"))
    each = found.where(F.size("c") > 0).select("id", "path", "key", "row", F.posexplode(zipped).alias("k", "x")).where(F.col("x.c").isNotNull())
    each = each.select("id", "path", "key", "row", "k", F.col("x.c").alias("candidate"), F.char_length("x.s").cast("long").alias("gap"), F.right(F.col("x.s"), F.lit(CONTEXT)).alias("left"), F.left(F.coalesce(F.col("x.n"), F.lit("")), F.lit(CONTEXT)).alias("right"))
    before = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.char_length("candidate")).over(before), F.lit(0)) + F.col("gap")
    return each.withColumn("start", start.cast("long")).select("id", "path", "key", "k", "start", "candidate", "left", "right")


def _key(text_col: str, path_col: str) -> Column:
    """What findings depend on: the text and the path (null as empty)."""
    return F.md5(F.concat(F.coalesce(F.col(path_col).cast("string"), F.lit("")), F.lit("\u0000"), F.col(text_col)))


def _scored(docs: DataFrame, id_col: str, text_col: str, path_col: str, labelled: DataFrame | None, least: float) -> DataFrame:
    known = learn(docs, text_col)
    model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession, words=[*CODE_WORDS, *known.others]), known)
    scored = model.transform(features(candidates(docs, id_col, text_col, path_col), known))
    score = vector_to_array("probability")[1]
    return scored.withColumns({"score": score, "is_secret": score >= least})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """One row a candidate: id, start, length, candidate, score, is_secret (score at least `least`).

    Null and empty texts have none; very long texts and candidates are read whole, in time that grows with their length;
    null paths are no sample paths; repeated rows repeat their findings; a null id stays null; empty tables
    give no rows; other columns aren't read. Without labelled findings of one's own, those of
    labelled_findings() train the forest.
    """
    scored = _scored(docs, id_col, text_col, path_col, labelled, least)
    return scored.select("id", "start", F.char_length("candidate").cast("long").alias("length"), "candidate", "score", "is_secret")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", mark: str = "<secret>", labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """docs with mark in the place of every secret; all other text is as it was, the same characters elsewhere included.

    Findings belong to a text under a path, so rows share them only if both are equal, whatever their
    ids. Null texts and documents without a secret stay as they are; empty tables give no rows; other
    columns are kept, and n_chars follows the text.
    """
    found = _scored(docs, id_col, text_col, path_col, labelled, least).where("is_secret")
    of_text = found.groupBy(F.col("key").alias("__key")).agg(F.collect_set("k").alias("__found"))
    text, trace = F.col(text_col), F.coalesce(F.col(text_col).rlike(TRACE), F.lit(False))
    joined = docs.where(trace).withColumn("__own", _key(text_col, path_col)).join(of_text, F.col("__own") == F.col("__key"), "left")
    changed: Column = F.col("__found").isNotNull()
    between = F.split(text, CANDIDATE, -1)
    parts = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda c, k: F.concat(F.get(F.col("__between"), k), F.when(F.array_contains(F.col("__found"), k), F.lit(mark)).otherwise(c)))
    out = joined.withColumn("__between", F.when(changed, between))
    out = out.withColumn(text_col, F.when(changed, F.concat(F.array_join(parts, ""), F.element_at(F.col("__between"), -1))).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return docs.where(~trace).unionByName(out.select(*docs.columns))
