import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import infill
from tests.llm.helpers import DOCS, documents, odd_documents


@settings(max_examples=500, deadline=None)
@given(st.text("ab\né", max_size=40), st.sampled_from(["\n", ".!"]))
def test_places_are_unit_ends(text, ends):
    text = text.replace("a", "." if ends != "\n" else "a")
    units = re.findall(f"[^{ends}]*[{ends}]|[^{ends}]+", text)
    runs = infill.Runs(text.encode(), ends.encode())
    assert runs.total == len(units)
    assert [runs.place(u) for u in range(len(units) + 1)] == [len("".join(units[:u]).encode()) for u in range(len(units) + 1)]


def brute(doc, text, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= rate:
        return doc, len(units), "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc, len(units), "spm" if h[3] % 100 < spm else "psm", len(pre), len(mid), out


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 20), (0, 50)])
def test_against_brute_force(spark, rate, spm):
    rows = odd_documents()
    rows += [(100 + k, t, "en", "a") for k, t in enumerate(["a\nb\nc", "\n\n\n", "a\n\n\nb\n", "x <P> y\nz", "<S>", "<M>\n", "<p>\n<s>", "é\n☃\n\n𝄞 end", "\r\na\r\n", "a" * 300_000 + "\n" + "b\n" * 50_000])]
    rows += [(200 + k, "line one\nline two\nthird", "en", "a") for k in range(40)]
    out = infill.fill_in_middle(documents(spark, rows), rate=rate, spm_rate=spm)
    got = [tuple(r) for r in out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()]
    assert sorted(map(repr, got)) == sorted(repr((*brute(d, t, rate, spm), t or "")) for d, t, *_ in rows)


def test_empty(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
