"""Domain data derived from the generic tables: variant counts from line items, reads from events.

The wildtype codes MADEVLTGRY. A part key picks up to two positions and bases to change; an order key the replicate; a
line's status input or output; its quantity the count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WT = "atggctgatgaagttctgaccggtcgttac"
#: The same with a constant head.
CODED = WT[:6] + WT[6:].upper()
REPS = [1, 2, 3]
COUNTS = [f"count_e{e}_s{s}" for e in REPS for s in (0, 1)]


def _base(index) -> F.Column:
    return F.substring(F.lit("acgt"), (index % 4 + 1).cast("int"), F.lit(1))


def _put(seq, place, base) -> F.Column:
    return F.concat(F.substring(seq, F.lit(1), place - 1), base, F.substring(seq, place + 1, F.lit(len(WT))))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nt_seq, e, s, line, key and quantity of every line item."""
    k = F.col("l_partkey")
    div = lambda n: F.floor(k / n)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_orderkey") % 3 + 1).cast("int").alias("e"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("s"),
        F.col("l_linenumber").alias("line"),
        k.alias("key"),
        (k * 7 % 30 + 1).cast("int").alias("p1"),
        ((k * 13 + div(120)) % 30 + 1).cast("int").alias("p2"),
        _base(div(30)).alias("b1"),
        _base(div(11)).alias("b2"),
    )
    one = F.when(F.col("key") % 4 == 0, F.lit(WT)).otherwise(_put(F.lit(WT), F.col("p1"), F.col("b1")))
    items = items.withColumn("one", one)
    two = F.when(F.col("key") % 4 <= 1, F.col("one")).otherwise(_put(F.col("one"), F.col("p2"), F.col("b2")))
    return items.select(two.alias("nt_seq"), "e", "s", "line", "key", "quantity")


def long_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = F.concat(F.lit("count_e"), F.col("e").cast("string"), F.lit("_s"), F.col("s").cast("string"))
    return reads(spark, sf_dir).select("nt_seq", F.col("quantity").alias("count"), sample.alias("sample_id"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varsift.operators.counts import pivot

    return pivot(long_counts(spark, sf_dir), COUNTS).select("nt_seq", *COUNTS)


def with_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in which some sequences have a base too many or too few."""
    from varsift.operators.counts import pivot

    k, seq = F.col("key"), F.col("nt_seq")
    changed = F.when(k % 17 == 0, F.concat(seq, F.lit("a"))).when(k % 19 == 0, F.substring(seq, F.lit(2), F.lit(len(WT)))).otherwise(seq)
    sample = F.concat(F.lit("count_e"), F.col("e").cast("string"), F.lit("_s"), F.col("s").cast("string"))
    rows = reads(spark, sf_dir).select(changed.alias("nt_seq"), F.col("quantity").alias("count"), sample.alias("sample_id"))
    return pivot(rows, COUNTS).select("nt_seq", *COUNTS)


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of reads: sequences from event ids, qualities even but for one base in some."""
    i = F.col("event_id")
    dna = lambda salt: F.translate(F.md5(F.concat(i.cast("string"), F.lit(salt)).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    cut = lambda x, n: F.substring(x, F.lit(1), n)
    n1, n2 = (F.lit(12) + i % 20).cast("int"), (F.lit(20) - i % 11).cast("int")
    good = lambda n: F.repeat(F.char(F.lit(33) + (i % 9 + 28)), n)
    low = lambda n: F.concat(F.lit("#"), F.repeat(F.lit("I"), n - 1))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("sample_id"),
        i.alias("read_id"),
        cut(dna("x"), n1).alias("seq1"),
        F.when(i % 13 == 0, low(n1)).otherwise(good(n1)).alias("qual1"),
        cut(dna("y"), n2).alias("seq2"),
        good(n2).alias("qual2"),
    )


# --- the same in SQL ----------------------------------------------------------------------------------------------

READS_SQL = f"""
keyed as (
  select cast(l_quantity as bigint) as quantity, cast(l_orderkey % 3 + 1 as int) as e, case when l_linestatus = 'O' then 1 else 0 end as s,
         l_linenumber as line, l_partkey as key, cast(l_partkey * 7 % 30 + 1 as int) as p1, cast((l_partkey * 13 + l_partkey // 120) % 30 + 1 as int) as p2,
         substr('acgt', cast((l_partkey // 30) % 4 + 1 as int), 1) as b1, substr('acgt', cast((l_partkey // 11) % 4 + 1 as int), 1) as b2
  from lineitem
), changed as (
  select *, case when key % 4 = 0 then '{WT}' else substr('{WT}', 1, p1 - 1) || b1 || substr('{WT}', p1 + 1) end as one from keyed
), reads as (
  select case when key % 4 <= 1 then one else substr(one, 1, p2 - 1) || b2 || substr(one, p2 + 1) end as nt_seq, e, s, line, key, quantity from changed
)"""


def _cells(source: str, seq: str = "nt_seq") -> str:
    cells = ", ".join(f"cast(coalesce(sum(case when e = {e} and s = {s} then quantity end), 0) as bigint) as count_e{e}_s{s}" for e in REPS for s in (0, 1))
    return f"select {seq} as nt_seq, {cells} from {source} group by 1"


VARIANTS_SQL = f"{READS_SQL}, variants as ({_cells('reads')})"
INDELS_SQL = f"{READS_SQL}, variants as ({_cells('reads', 'case when key % 17 = 0 then nt_seq || ' + chr(39) + 'a' + chr(39) + ' when key % 19 = 0 then substr(nt_seq, 2) else nt_seq end')})"

_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def amino_sql(seq: str, n: int = 10) -> str:
    place = lambda i: f"strpos('tcag', substr({seq}, {i}, 1))"
    return " || ".join(f"substr('{_AMINO}', cast(16 * ({place(3 * i + 1)} - 1) + 4 * ({place(3 * i + 2)} - 1) + {place(3 * i + 3)} as int), 1)" for i in range(n))


def differ_sql(seq: str, ref: str) -> str:
    return "(" + " + ".join(f"cast(substr({seq}, {i + 1}, 1) <> '{c}' as int)" for i, c in enumerate(ref)) + ")"


def codons_sql(seq: str, ref: str) -> str:
    return "(" + " + ".join(f"cast(substr({seq}, {i + 1}, 3) <> '{ref[i : i + 3]}' as int)" for i in range(0, len(ref), 3)) + ")"


def positions_sql(seq: str, ref: str) -> str:
    return "concat_ws(',', " + ", ".join(f"case when substr({seq}, {i + 1}, 1) <> '{c}' then '{i + 1}' end" for i, c in enumerate(ref)) + ")"


WT_AMINO = "MADEVLTGRY"
ANNOTATED_SQL = f"""{VARIANTS_SQL}, translated as (
  select *, {amino_sql('nt_seq')} as aa_seq from variants
), annotated as (
  select *, {differ_sql('nt_seq', WT)} as Nham_nt, {differ_sql('aa_seq', WT_AMINO)} as Nham_aa, {codons_sql('nt_seq', WT)} as Nmut_codons,
         nt_seq = '{WT}' as WT, strpos(substr(aa_seq, 1, 9), '*') > 0 as STOP, false as STOP_readthrough
  from translated
), retained as (
  select * from annotated where Nham_aa <= 2 and not (Nmut_codons <> Nham_aa and Nham_aa <> 0)
)"""
EVENTS_SQL = """
pairs as (
  select event_type as sample_id, event_id as read_id, event_id as i,
         substr(translate(md5(cast(event_id as varchar) || 'x'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(12 + event_id % 20 as int)) as seq1,
         substr(translate(md5(cast(event_id as varchar) || 'y'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, cast(20 - event_id % 11 as int)) as seq2
  from events
), quality as (
  select *, event_quality as q1, case when i % 13 = 0 then 2 else event_quality end as least1
  from (select *, i % 9 + 28 as event_quality from pairs)
)"""
