"""Splitting oversized items at natural boundaries by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.session import read

MOST, OVERLAP = 2000, 200
#: Penalty of a cut behind a blank line, a line end, a sentence, a clause, a space or comma, and anywhere else.
PENALTIES = {"paragraph": 0.0, "line": 0.1, "sentence": 0.25, "clause": 0.6, "pause": 1.0, "none": 4.0}
#: Weight of the squared deviation of a piece's new text from an even share.
BALANCE = 1.0
#: Cuts that are costed together.
ROWS = 64
#: Where no boundary stands within so many characters, plain positions at this distance may be cut.
GAP = 100

BOUNDARY = re.compile(r"(?P<paragraph>\n\s*\n)|(?P<line>\n)|(?P<sentence>[。！？!?…]+[”』」）)]*|\.(?=\s|$))|(?P<clause>[；;：:])|(?P<pause>[，、,\s])")
PIECES = "section_id bigint, piece int, start bigint, length int, overlap int, text string"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a text may be cut, ascending and with 0 and its end, and the penalty of each."""
    at, cost = [0], [0.0]
    for match in BOUNDARY.finditer(text):
        end = match.end()
        while end - at[-1] > GAP:
            at.append(at[-1] + GAP)
            cost.append(PENALTIES["none"])
        if end > at[-1]:
            at.append(end)
            cost.append(PENALTIES[match.lastgroup])
        elif end == at[-1]:
            cost[-1] = min(cost[-1], PENALTIES[match.lastgroup])
    while len(text) - at[-1] > GAP:
        at.append(at[-1] + GAP)
        cost.append(PENALTIES["none"])
    if at[-1] < len(text):
        at.append(len(text))
        cost.append(0.0)
    cost[-1] = 0.0
    return np.array(at), np.array(cost)


def split_text(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, end, characters repeated from the piece before), each of at most `most` characters.

    A text of up to `most` characters is one piece, an empty one none. Each later piece begins at the best boundary within
    the last `overlap` characters of the one before. The cuts minimise penalties and imbalance over all positions.
    """
    n = len(text)
    if n <= most:
        return [(0, n, 0)] if n else []
    at, cost = boundaries(text)
    # the piece that follows a cut begins at the least penal boundary, the earliest of those, within the overlap
    lows = np.searchsorted(at, at - overlap, "left")
    chosen = np.arange(len(at))
    for penalty in np.unique(cost)[::-1]:  # the least penalty is set last
        places = np.append(np.flatnonzero(cost == penalty), len(at))
        found = places[np.searchsorted(places, lows)]
        chosen = np.where(found < np.arange(len(at)), found, chosen)
    begin = at[chosen]
    even = n / np.ceil(n / (most - overlap))
    best, back = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
    best[0] = 0.0
    firsts = np.searchsorted(at, at - most, "left")  # no piece that ends at k begins behind an earlier cut
    for start in range(1, len(at), ROWS):
        rows = np.arange(start, min(start + ROWS, len(at)))
        low = int(firsts[start])
        j = np.arange(low, rows[-1])
        # what each pair of cuts costs by its size, for a block of rows at once; only the running best depends on the order
        sizes = BALANCE * ((at[rows, None] - at[None, j] - even) / most) ** 2
        sizes[(at[rows, None] - begin[None, j] > most) | (j[None, :] >= rows[:, None])] = np.inf
        for k, first, row in zip(rows.tolist(), firsts[rows].tolist(), sizes):
            total = best[first:k] + row[first - low : k - low]
            pick = total.argmin()
            best[k], back[k] = total[pick] + cost[k], first + pick
    pieces, k = [], len(at) - 1
    while k:
        j = int(back[k])
        pieces.append((int(begin[j]), int(at[k]), int(at[j] - begin[j])))
        k = j
    return pieces[::-1]


def long_sections(sections: DataFrame, texts: DataFrame) -> DataFrame:
    """(section_id, file, pos), (file, text) -> file, text, sections: those of more than MOST characters in each file.

    A section ends at the next larger pos of its file or at the text's end; sections and files delivered again count
    once, sections without pos or file text give nothing.
    """
    spark = sections.sparkSession
    # one partitioning by file for both sides; its number is kept, as cutting costs more than its bytes tell
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    known = sections.select("file", "section_id", "pos").filter("file is not null and pos is not null").repartition(tasks, "file").distinct()
    per_file = known.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "section_id"))).alias("all"))
    one = texts.select("file", "text").filter("text is not null").repartition(tasks, "file").dropDuplicates(["file"])
    joined = one.join(per_file, "file")
    starts = F.array_distinct(F.transform("all", lambda s: s["pos"]))
    following = F.map_from_arrays(starts, F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.length("text").cast("int"))))
    spans = F.transform("all", lambda s: F.struct(s["section_id"].alias("section_id"), s["pos"].alias("pos"), F.element_at("following", s["pos"]).alias("stop")))
    spans = joined.withColumn("following", following).withColumn("spans", F.filter(spans, lambda s: s["stop"] - s["pos"] > MOST))
    return spans.filter(F.size("spans") > 0).select("file", "text", "spans")


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text, spans in zip(batch["text"], batch["spans"]):
            rows = []
            for span in spans:
                own = text[span["pos"] : span["stop"]]
                for k, (start, end, repeated) in enumerate(split_text(own)):
                    rows.append((span["section_id"], k, span["pos"] + start, end - start, repeated, own[start:end]))
            yield pd.DataFrame(rows, columns=["section_id", "piece", "start", "length", "overlap", "text"])


def split_sections(sections: DataFrame, texts: DataFrame) -> DataFrame:
    """Ordered pieces of the long sections: section_id, piece, start in the file, length, overlap, text."""
    return long_sections(sections, texts).mapInPandas(_cut, PIECES)


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every section of more than 2,000 characters."""
    return split_sections(read(spark, sf_dir, "kb_search_index"), read(spark, sf_dir, "kb_md"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that had to be split."""
    return p7_pieces(spark, sf_dir).filter("piece = 1").select("section_id").distinct()


QUERIES = {"p7_pieces": p7_pieces, "p7_found": p7_found}
ORACLES = {
    "p7_found": """
with files as (select file, any_value(text) as body from kb_md where text is not null group by file),
starts as (select distinct file, pos from kb_search_index where file is not null and pos is not null),
spans as (select file, pos, lead(pos) over (partition by file order by pos) as stop from starts)
select distinct s.section_id from kb_search_index s join spans p on s.file = p.file and s.pos = p.pos join files f on f.file = s.file
where coalesce(p.stop, length(f.body)) - p.pos > 2000"""
}
