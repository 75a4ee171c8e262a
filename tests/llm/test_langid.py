import math
import zlib

from tessera.llm import langid
from tests.llm.helpers import DE, DOCS, EN, FR, documents, odd_documents

ES = "el rápido zorro marrón salta sobre el perro perezoso y luego el otro perro piensa en esta cosa con ellos "
NL = "de snelle bruine vos springt over de luie hond en dan denkt de andere hond na over dit ding met hen "


def test_odd_rows(spark):
    rows = odd_documents()
    got = langid.identify(documents(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, *_ in rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in (5, 6, 7, 10):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in {"en", "de", "fr"}


def test_learns_languages_within_families(spark):
    rows = [(i, {0: EN, 1: DE, 2: FR}[i % 3][i % 7 :] * 2, {0: "en", 1: "de", 2: "fr"}[i % 3], "a") for i in range(90)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(documents(spark, rows)).collect()}
    assert all(got[d] == lang for d, _, lang, _ in rows)


def test_labels_of_held_out_rows_and_sources_do_not_matter(spark):
    rows = [(i, {0: EN, 1: DE, 2: FR}[i % 3][i % 7 :] * 2, {0: "en", 1: "de", 2: "fr"}[i % 3], "a") for i in range(60)]
    other = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 5 == 0 else g, "z") for d, t, g, _ in rows]
    a, b = (sorted(map(repr, langid.identify(documents(spark, x)).collect())) for x in (rows, other))
    assert a == b


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in langid.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.98 * len(held) > 100


def test_every_labelled_text_is_learnt_from(spark):
    """Ten English texts, each in letters of its own, among 4,000: a few hundred a language would leave most of them out."""
    rare = ["".join(chr(0x4E00 + 50 * k + j) for j in range(40)) for k in range(10)]
    rows = [(k, EN[k % 50 :], "en", "a") if k % 2 else (k, DE[k % 50 :], "de", "a") for k in range(4000)] + [(5000 + k, t, "en", "a") for k, t in enumerate(rare)]
    taught = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    model = langid.fit(documents(spark, rows))
    codes = lambda texts: {c for t in texts for c in langid.trigram_codes(langid.cleaned(t)).tolist()}
    own = codes(t for d, t, *_ in taught if d >= 5000) - codes(t for d, t, *_ in taught if d < 5000)
    assert len(own) > 100 and all(model.weights[0][c] < 0 for c in own)  # de against en


def test_nothing_to_learn_from(spark):
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0
    assert {r.lang_pred for r in langid.identify(documents(spark, [(1, EN, None, "a"), (2, None, "en", "b")])).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(documents(spark, [(k, EN, "en", "a") for k in range(1, 9)])).collect()} == {"en"}


def test_rejected_documents_go(spark):
    rows = odd_documents()
    kept = langid.keep_identified(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 2, 3, 4} <= ids and not {5, 6, 7, 10} & ids


def brute_prediction(model, text):
    """Language and score of one text by plain loops over its trigrams, from the fitted weights."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    kept = "".join(c if ord(c) >= 128 or "a" <= c <= "z" else " " for c in text.lower())
    data = (" " + " ".join(w for w in kept.split(" ") if w) + " ").encode("utf-8")
    codes = [((a << 16 | b << 8 | c) * 2654435761) % 2**32 >> 32 - langid.BITS for a, b, c in zip(data, data[1:], data[2:])]
    margins = [sum(float(w[c]) for c in codes) / len(codes) + float(b) for w, b in zip(model.weights, model.bias)]
    n = len(model.families) if len(model.families) > 1 else 0
    lead = sorted(margins[:n], reverse=True)
    best = model.families[margins.index(lead[0])] if n else model.families[0]
    least = [lead[0] - lead[1]] if n else []
    won = {x: [] for x in model.langs if langid.family(x) == best}
    for (a, b), m in zip(model.pairs, margins[n:]):
        if langid.family(a) == best:
            won[a].append(m)
            won[b].append(-m)
    lang = max(won, key=lambda x: (len([m for m in won[x] if m > 0]), sum(won[x])))
    return lang, 1 / (1 + math.exp(-2 * max(-30, min([30, *least, *won[lang]]))))


def test_predictions_against_brute_force(spark):
    labelled = [(100 + i, {0: EN, 1: DE, 2: FR, 3: ES, 4: NL}[i % 5][i % 7 :] * (1 + i % 3), ("en", "de", "fr", "es", "nl")[i % 5], "a") for i in range(100)]
    odd = [(k, t, None, "a") for k, t in enumerate(["a", "É", "ab 12 CD", EN + FR, DE + NL + "☃", "  x\ty  ", "ΑΒΓ αβγ", "1 2 3", None, "", "Ünï " * 3000])]
    docs = documents(spark, labelled + odd + odd_documents())
    model = langid.fit(docs)
    got = {}
    for r in langid.predict(docs, model).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert len(model.pairs) == 4 and got.keys() == texts.keys()
    for doc, found in got.items():
        wanted = sorted(brute_prediction(model, t) for t in texts[doc])
        for (lang, score), (lang_2, score_2) in zip(sorted(found), wanted, strict=True):
            assert lang == lang_2 and abs(score - score_2) < 1e-6
