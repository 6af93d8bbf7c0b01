"""Secret scans with built-in functions only (operator 6).

Base rules find assignments, access keys and long hexadecimal runs. The method adds what they miss: two first-order
Markov models of characters, one of random strings and one of ordinary identifiers, trained from a bounded sample of
documents in which the base rules label the random strings and all other tokens are ordinary. A token of
CANDIDATE_LEAST or more characters is a secret if its log-likelihood ratio reaches RATIO and it touches no base span.

Counting, training data and scoring all run as DataFrame operations; the driver gets at most 2 * 69 * 69 counts of
character pairs and sends them back as one literal array. Smoothing makes the models defined on any sample, even an
empty one.

Defined cases: a null text is an empty one and has no spans; a null doc_id is carried; repeated rows give repeated
results; a text is read whole, however long; an empty table gives an empty result; extra columns are kept, but for those
that have the name of a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varsift.llm import common, native_spans

#: The base rules.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
CANDIDATE_LEAST = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_LEAST
TOKEN = r"[A-Za-z0-9+/_=-]{6,}"
#: Natural logarithm of the odds that a token must reach.
RATIO = 15.0
#: Weight, in counts, of what a model expects before it has seen a pair of characters.
LEANING = 100.0
#: Documents of the training sample.
SAMPLE_DOCS = 4000


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with columns assign, access, hex of spans.

    A run shorter than its rule asks for can't hide a longer one behind it, so the two runs of one character class
    carry their least length in the pattern; an assignment's value is checked after the match, as a short one does
    use up its text.
    """
    docs = native_spans.find(docs, text, "assign", ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8)
    docs = native_spans.find(docs, text, "access", ACCESS, 1, lambda m: F.lit(True))
    return native_spans.find(docs, text, "hex", HEX, 2, lambda m: F.lit(True))


def _place(c: Column) -> Column:
    """1 to 67 for characters of the alphabet, by their codes; 0 for any other."""
    a = F.ascii(c)
    return (
        F.when((a >= 97) & (a <= 122), a - 96)
        .when((a >= 65) & (a <= 90), a - 38)
        .when((a >= 48) & (a <= 57), a + 5)
        .when(a == 43, 63)
        .when(a == 47, 64)
        .when(a == 95, 65)
        .when(a == 61, 66)
        .when(a == 45, 67)
        .otherwise(0)
    )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-likelihood ratio of each pair of states, at [before * STATES + after]; state 0 is a token's start."""
    chosen = docs.select(F.col(id_col).alias("chosen")).where("chosen is not null").distinct().orderBy(F.xxhash64("chosen", F.lit("secrets"))).limit(SAMPLE_DOCS)
    rows = docs.join(F.broadcast(chosen), docs[id_col] == F.col("chosen")).select(F.col(text_col).alias("t")).where("t is not null")
    rest = F.col("t")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    values = F.concat(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    labelled = rows.select(F.lit(1).alias("random"), F.explode(F.filter(values, lambda v: F.length(v) >= 8)).alias("token")).union(
        rows.select(F.lit(0).alias("random"), F.explode(F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0))).alias("token"))
    )
    states = F.transform(F.split("token", ""), _place)
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), states), states, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # the aggregate has at most 2 * STATES * STATES rows
    counts = labelled.select("random", F.explode(pairs).alias("p")).where("p.a is not null and p.b > 0").groupBy("random", "p.a", "p.b").count().collect()
    return ratios({(r["random"], r["a"], r["b"]): r["count"] for r in counts})


def _kind(state: int) -> int:
    """Start, lower case, upper case, digit, other."""
    return 0 if not state else 1 if state <= 26 else 2 if state <= 52 else 3 if state <= 62 else 4


def ratios(seen: dict[tuple[int, int, int], int]) -> list[float]:
    """Log-likelihood ratios from counts by (random, before, after).

    Pairs of characters lean on what their model expects without having seen them: random strings on uniform
    characters, identifiers on how often one kind of character follows another.
    """
    totals: dict[tuple[int, int], int] = {}
    kinds: dict[tuple[int, int], int] = {}
    for (random, a, b), n in seen.items():
        totals[random, a] = totals.get((random, a), 0) + n
        if not random:
            kinds[_kind(a), _kind(b)] = kinds.get((_kind(a), _kind(b)), 0) + n
    sizes = {1: 26, 2: 26, 3: 10, 4: 5}

    def log_p(random: int, a: int, b: int) -> float:
        if random:
            expected = 1 / (STATES - 1)
        else:
            row = [kinds.get((_kind(a), k), 0) + 1 for k in sizes]
            expected = row[_kind(b) - 1] / sum(row) / sizes[_kind(b)]
        return math.log((seen.get((random, a, b), 0) + LEANING * expected) / (totals.get((random, a), 0) + LEANING))

    return [log_p(1, a, b) - log_p(0, a, b) if b else 0.0 for a in range(STATES) for b in range(STATES)]


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token."""
    literal = F.array(*[F.lit(round(x, 6)) for x in table])
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    walked = F.aggregate(
        F.filter(F.transform(F.split(token, ""), _place), lambda s: s > 0),
        start,
        lambda state, s: F.struct(s.alias("before"), (state["sum"] + F.element_at(literal, state["before"] * STATES + s + 1)).alias("sum")),
    )
    return walked["sum"]


def scan(docs: DataFrame, table: list[float], text_col: str = "text") -> DataFrame:
    """docs with the array columns assign, access, hex and markov of spans, in place of columns of these names."""
    # the columns of docs go by in one struct, so that their names can't clash with those made here
    row = F.struct(*(F.col(f"`{c}`") for c in common.others(docs, KINDS)))
    found = base_spans(docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), "text")
    found = native_spans.find(found, "text", "markov", CANDIDATE, 3, lambda m: ratio(m, table) >= RATIO)
    base = F.concat("assign", "access", "hex")
    apart = F.filter("markov", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return found.select("row.*", "assign", "access", "hex", F.when(F.size("markov") > 0, apart).otherwise(F.col("markov")).alias("markov"))


def mask(docs: DataFrame, table: list[float], text_col: str = "text", by: str = "[secret]") -> DataFrame:
    """docs whose secrets are replaced in the text; other columns stay as they were."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text_col)]
    found = scan(docs.toDF(*names), table, at)
    found = found.withColumn("_spans", F.array_sort(F.concat("assign", "access", "hex", "markov")))

    def step(state: Column, span: Column) -> Column:
        # spans of two kinds may overlap; what is behind the furthest end so far is kept
        ahead = span["start"] >= state["at"]
        piece = F.when(ahead, F.concat(F.substring(F.col(at), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int")), F.lit(by))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

    walked = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), step)
    found = found.withColumn("_walked", F.when(F.size("_spans") > 0, walked))
    text = F.when(F.col("_walked").isNull(), F.col(at)).otherwise(F.concat(F.array_join("_walked.out", ""), F.expr(f"substring({at}, cast(_walked.at + 1 as int))")))
    return found.select(*((text if n == at else F.col(n)).alias(c) for n, c in zip(names, docs.columns)))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs)).withColumns(
        {"base": F.array_sort(F.concat("assign", "access", "hex")), "every": F.array_sort(F.concat("assign", "access", "hex", "markov"))}
    )
    return found.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(native_spans.joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        native_spans.joined(F.col("every"), KINDS).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )
