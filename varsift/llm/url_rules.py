"""URL rules by a sort-merge range join (operator 7).

A host's labels, reversed and each closed by a slash (org/example/www/), form a key in which a host and all of its
subdomains are one interval: the keys that begin with the host's key. Urls are dealt out and sorted by that key, then
by path and a hash, so a host that many urls share is spread over tasks. Each task sweeps its sorted urls along the
sorted rules and keeps a stack of the rules whose intervals are open: entering pushes, leaving pops, and what is on the
stack is nested by construction. The open rules' paths are then matched, and the longest rule that fits wins.

Rules travel to the executors in chunks of RULES_A_PASS; larger sets take more passes over the sorted urls, which keep
their order, so nothing unbounded is broadcast and nothing is shuffled again.

Defined cases: a url that is null or has no "://" has an empty host and path and fits no rule; a rule with a null or
empty host takes no part, a null path is empty; among rules of equal length that fit, the longer host wins, then block
before allow; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varsift.llm import common

#: Rules that are broadcast at once.
RULES_A_PASS = 100_000
PASSES_A_PLAN = 8


@dataclass(frozen=True, order=True)
class Rule:
    key: bytes
    path: bytes
    host: bytes
    verdict: str

    @classmethod
    def of(cls, host: str, path: str, verdict: str) -> Rule:
        host = "".join(c.lower() if c.isascii() else c for c in host)
        return cls("".join(f"{label}/" for label in reversed(host.split("."))).encode(), path.encode(), host.encode(), verdict)

    @property
    def strength(self) -> tuple[int, int, bool]:
        return len(self.host) + len(self.path), len(self.host), self.verdict == "block"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return common.lower_az(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


class Sweep:
    """The sorted rules and the stack of those that are open at the current key."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.keys = [r.key for r in rules]
        self.next = 0
        self.open: list[Rule] = []
        self.started = False

    def move(self, key: bytes) -> None:
        """Go on to a key that isn't below the last one."""
        if not self.started:
            # rules of other top-level labels cannot hold this key
            self.next = bisect_left(self.keys, key[: key.index(b"/") + 1])
            self.started = True
        while self.open and not key.startswith(self.open[-1].key):
            self.open.pop()
        while self.next < len(self.rules) and self.keys[self.next] <= key:
            rule = self.rules[self.next]
            if key.startswith(rule.key):
                self.open.append(rule)
                self.next += 1
            else:  # closed before this key: go on to the first rule that may hold it
                self.next = max(self.next + 1, self._from(key))

    def _from(self, key: bytes) -> int:
        """The first rule, from the current one on, that is a prefix of the key, or the first above the key."""
        end = 0
        while (end := key.find(b"/", end) + 1) > 0:
            at = bisect_left(self.keys, key[:end], self.next)
            if at < len(self.keys) and self.keys[at] == key[:end]:
                return at
        return bisect_left(self.keys, key, self.next)

    def best(self, path: bytes) -> Rule | None:
        return max((r for r in self.open if path.startswith(r.path)), key=lambda r: r.strength, default=None)


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every url. rules: Rule objects or rows of host, path, verdict."""
    spark = pages.sparkSession
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = split_url(F.col("url"))
    keyed = named.select("page_id", host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("key", F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "/"), F.lit("/")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.repartitionByRange(parts, "key", "path", F.xxhash64("page_id")).sortWithinPartitions("key", "path")
    done = keyed.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(-1).cast("long").alias("rank"))
    passes = 0
    for chunk in _chunks(rules):
        if passes and passes % PASSES_A_PLAN == 0:
            done = common.stored(done, "urls")
        done = _passed(done, chunk)
        passes += 1
    return done.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def _chunks(rules: list[Rule] | DataFrame) -> Iterator[list[Rule]]:
    rows = rules if isinstance(rules, list) else (Rule.of(r.host, r.path or "", r.verdict) for r in rules.select("host", "path", "verdict").toLocalIterator() if r.host)
    held: list[Rule] = []
    for rule in rows:
        held.append(rule)
        if len(held) == RULES_A_PASS:
            yield held
            held = []
    if held:
        yield held


def _passed(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    sent = urls.sparkSession.sparkContext.broadcast(sorted(rules))
    schema = urls.schema
    to = common.arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, last = Sweep(sent.value), None
        for batch in batches:
            columns = {n: batch.column(n) for n in to.names}
            rule, verdict, rank = (columns[n].to_pylist() for n in ("rule", "verdict", "rank"))
            for i, (key, path) in enumerate(zip(common.text_bytes(columns["key"]), common.text_bytes(columns["path"]))):
                if last is not None and key < last:  # a written table read again starts a new sorted run
                    sweep = Sweep(sent.value)
                if key != last:
                    sweep.move(key)
                    last = key
                found = sweep.best(path) if sweep.open else None
                # strengths as one number: length, then host, then block; an earlier pass' rule stands unless beaten
                if found and (power := (found.strength[0] << 17) + (min(found.strength[1], 65535) << 1) + found.strength[2]) > rank[i]:
                    rule[i], verdict[i], rank[i] = (found.host + found.path).decode(), found.verdict, power
            columns |= {"rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string()), "rank": pa.array(rank, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in to], schema=to)

    return common.map_arrow(urls, run, schema)


#: The rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for the url of every page."""
    return judge(common.table(spark, sf_dir, "pages"), [Rule.of(*r) for r in RULES])


SQL = """
with cut as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from cut
), rules(rule_host, rule_path, rule_verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits as (
  select p.*, r.rule_host || r.rule_path as rule, r.rule_verdict,
         row_number() over (partition by page_id order by length(r.rule_host || r.rule_path) desc nulls last, length(r.rule_host) desc) as place
  from parts p left join rules r
    on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path)
)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from fits where place = 1
"""
