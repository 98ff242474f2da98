"""Fill-in-middle transformation: a text is cut into units, and its prefix, middle
and suffix are put in an order that lets a left-to-right model learn to fill gaps.

The units are found by repeated-capture matching: one ``fullmatch`` of ``(unit)*``
with the regex library keeps every repetition of the group, so ``match.ends(1)``
holds the end of each unit; its length is the number of units and both cut offsets
are read from it.  A text over ``SPAN`` code points is matched ``SPAN`` units at a
time, each match going on where the last ended.  Repetitions are possessive, so that
gives the units of one match; its memory is that of a stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, map_arrow, table

SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those with a remainder from PLAIN on stay plain; of the others, those below SPM are spm.
PLAIN, SPM = 90, 20
SPAN = 1 << 18

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass
class Units:
    """The units of one text: their number and where the kth ends."""

    stretches: list[tuple[int, int]]  # start of each stretch and its units
    n: int
    ends: list[int]  # of the only stretch, else empty
    again: object = None

    def end(self, k: int) -> int:
        """Code points before unit k."""
        if k == 0:
            return 0
        for start, count in self.stretches:
            if k <= count:
                return (self.ends or self.again(start))[k - 1]
            k -= count
        raise IndexError(k)


class Matcher:
    def __init__(self, unit: str = r"(?s:.)", span: int = SPAN):
        self.whole = regex.compile(f"({unit})*+")
        self.part = regex.compile(f"({unit}){{1,{span}}}+")
        self.span = span

    def units(self, text: str) -> Units | None:
        """None where the units don't make up the whole text."""
        if len(text) <= self.span:
            match = self.whole.fullmatch(text)
            if match is None:
                return None
            ends = match.ends(1)
            return Units([(0, len(ends))], len(ends), ends)
        stretches, at = [], 0
        while at < len(text):
            match = self.part.match(text, at)
            if match is None or match.end() == at:
                return None
            stretches.append((at, len(match.ends(1))))
            at = match.end()
        return Units(stretches, sum(n for _, n in stretches), [], lambda start: self.part.match(text, start).ends(1))


def transform(text: str, key: str, matcher: Matcher, sentinels: tuple[str, str, str] = SENTINELS,
              plain: int = PLAIN, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text; ``key`` decides cuts and form."""
    units = matcher.units(text)
    draws = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(draws[k:k + 8], 16) for k in range(0, 32, 8))
    n = units.n if units else 0
    if not text or units is None or h3 % 100 >= plain or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    a, b = (units.end(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = sentinels
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = r"(?s:.)", seed: str = "1:",
                   sentinels: tuple[str, str, str] = SENTINELS, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``unit`` is a pattern of the regex library without groups that never matches the
    empty text; the default is one code point.  Cuts and form are drawn from the
    sha256 of ``seed`` and the doc_id, so reruns agree and rows that repeat a doc_id
    and text come out alike.  A null doc_id is drawn from ``seed`` alone.  A null text
    counts as empty.  Empty texts, texts that hold a sentinel and texts that units don't
    make up (n 0) are plain: output is the text, and both lengths are null.  An empty
    table gives an empty result; columns other than doc_id and text are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(unit)
        for batch in batches:
            for part in blocks_of(batch, "text"):
                ids, texts = part.column("doc_id"), part.column("text")
                rows = [transform(t.as_py(), f"{seed}{'' if d is None else d}", matcher, sentinels, plain, spm)
                        for d, t in zip(ids.to_pylist(), texts)]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_arrow(narrow, run, SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from.  It holds no sentinel unless it is plain,
    so the three in the output are those put there."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    return F.when(form == "plain", output) \
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2])) \
        .otherwise(F.concat(parts[2], parts[3], parts[1]))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
             CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
             CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""
