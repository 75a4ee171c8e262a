"""Fill-in-the-middle: a text is cut at two unit ends and its parts are put in another order, between marks.

A text's bytes fall into maximal runs of two classes: those that end a unit (a line's end) and all others.
A run is stored with its start and the number of units complete before and after it. A cut after u units is
in the first run that completes at least u; as each byte of an ending run completes one, the place in it is
a difference. Nothing is split into units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches

MARKS = ("<P>", "<S>", "<M>")


class Runs:
    """Maximal runs of a text's bytes by class; units[k] are complete before run k, units[k + 1] after it."""

    def __init__(self, data: bytes, ends: bytes = b"\n") -> None:
        table = np.zeros(256, bool)
        table[list(ends)] = True
        ending = table[np.frombuffer(data, np.uint8)]
        self.size = len(data)
        self.starts = np.flatnonzero(np.concatenate((np.ones(min(1, self.size), bool), ending[1:] != ending[:-1])))
        completes = np.where(ending[self.starts], np.diff(np.append(self.starts, self.size)), 0)
        if self.size and not ending[-1]:
            completes[-1] = 1  # the end of the text
        self.units = np.concatenate((np.zeros(1, np.int64), np.cumsum(completes)))
        self.total, self.open = int(self.units[-1]), bool(self.size and not ending[-1])

    def place(self, unit: int) -> int:
        """Bytes up to the end of so many units."""
        if unit <= 0 or not self.size:
            return 0
        if unit >= self.total:
            return self.size
        run = int(np.searchsorted(self.units[1:], unit))
        return int(self.starts[run]) + unit - int(self.units[run])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, ends: str = "\n") -> DataFrame:
    """One row for each input row: id_col, n, form, prefix_chars, middle_chars, output.

    n counts units, each up to and with one of the ASCII characters `ends`, or what remains after the last. The
    SHA-256 of "seed:id" decides: its first four numbers of 32 bits give the two cuts, whether the text is
    transformed (rate in a hundred) and whether as spm (spm_rate in a hundred). Empty texts, null ones (taken
    as empty) and texts that hold a mark stay plain, without counts of characters. psm is prefix, suffix,
    middle; spm is suffix, prefix, middle; each part after its mark. A null id hashes as "seed:"; repeated rows
    give equal rows; very long texts are read whole, one row at a time; an empty table gives no rows; other
    columns aren't read.
    """
    bound_batches(docs.sparkSession)
    final, marks = ends.encode("ascii"), [m.encode() for m in MARKS]
    chars = lambda data: int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))

    def one(doc: int | None, data: bytes) -> tuple:
        digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
        runs = Runs(data, final)
        if not data or any(m in data for m in marks) or h3 % 100 >= rate:
            return doc, runs.total, "plain", None, None, data
        a, b = (runs.place(u) for u in sorted((h1 % (runs.total + 1), h2 % (runs.total + 1))))
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        parts = (marks[1], suffix, marks[0], prefix, marks[2], middle) if (spm := h4 % 100 < spm_rate) else (marks[0], prefix, marks[1], suffix, marks[2], middle)
        return doc, runs.total, "spm" if spm else "psm", chars(prefix), chars(middle), b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                rows = [one(batch.column(0)[k].as_py(), texts[k].as_py() or b"") for k in range(at, min(at + 256, batch.num_rows))]
                columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*columns[:5], columns[5].cast(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle came from."""
    part = F.split(output, "|".join(MARKS))
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
