"""The pipeline's stages, and the operators that SQL can't express, against plain Python on small tables."""

import json
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from locuslake.llm import decontamination, near_duplicates, pii, quality, toxicity

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().split()
    if not w:
        return None
    n = min(5, len(w))
    out = {}
    for k in range(len(w) - n + 1):
        out[tuple(w[k : k + n])] = out.get(tuple(w[k : k + n]), 0) + 1
    return out


def similarity(a, b):
    both = sum(min(n, b.get(k, 0)) for k, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    """Least id of each document's component under all pairs of similarity 0.8 or more."""
    runs = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(runs):
        for j, b in runs[:k]:
            if a and b and similarity(a, b) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def template(words):
    units = set(decontamination.UNITS)
    out = []
    for k, w in enumerate(words):
        low, last = w.lower(), words[k - 1] if k else ""
        out.append("<num>" if w < ":" else "<unit>" if "" < last < ":" and len(w) <= 7 and low in units else low if low == w or w.upper() == w else "<name>")
    return out


def brute_contaminated(text, item, window=8, coverage=0.3):
    find = lambda t: re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", t or "")
    words, own = find(text), find(item)
    form, item_form = template(words), template(own)
    if len(own) < window:
        low = [w.lower() for w in own]
        return len(own) >= 4 and any([w.lower() for w in words[k : k + len(own)]] == low for k in range(len(words) - len(own) + 1))
    places = {}
    for k in range(len(own) - window + 1):
        places.setdefault(tuple(item_form[k : k + window]), k)
    shifts = {}
    for k in range(len(words) - window + 1):
        if (at := places.get(tuple(form[k : k + window]))) is not None:
            shifts.setdefault(k - at, set()).add(at)
    for shift, found in shifts.items():
        if len(found) >= coverage * len(places):
            covered = {p for at in found for p in range(at, at + window)}
            slots = {(item_form[p], own[p], words[p + shift]) for p in covered if item_form[p].startswith("<")}
            literal = any(not item_form[p].startswith("<") for p in covered)
            if len(slots) == len({s[:2] for s in slots}) and (literal or all(a == b for _, a, b in slots)):
                return True
    return False


def test_contamination_of_all_documents(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    expected = {(r.doc_id, i) for r in documents.collect() for i, t in items if brute_contaminated(r.text, t)}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(documents, bench).collect()}
    assert got == expected and got


def test_surrogates_of_all_documents(documents):
    before = {r.doc_id: r.text for r in documents.collect()}
    out = pii.replace_pii(documents, length_col="n_chars", mentions_col="k").collect()
    mail = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
    card = re.compile(r"(?<![\d.-])\d{16}(?!\d)")
    seen = {}
    for r in out:
        old, new = before[r.doc_id], r.text
        assert r.n_chars == len(new) if r.k else new == old
        for find in (mail, card):
            a, b = find.findall(old or ""), find.findall(new or "")
            assert len(a) == len(b) and not set(a) & set(b)
            for x, y in zip(a, b):
                assert seen.setdefault(x, y) == y  # one value, one surrogate, in all documents
    assert len(set(seen.values())) == len(seen) > 0


def test_quality_scores_are_those_of_the_sum_over_pairs(spark, documents):
    model = quality.train(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    text = next(r.text for r in documents.collect() if r.text and len(r.text) < 2000)
    rng = np.random.default_rng(0)
    i, x = np.sort(rng.choice(len(model.linear), 30, replace=False)), rng.normal(size=30)
    pairs = sum(model.factors[i[a]] @ model.factors[i[b]] * x[a] * x[b] for a in range(30) for b in range(a))
    assert abs(model.logit(i, x) - (model.bias + model.linear[i] @ x + pairs)) < 1e-6 * (1 + abs(pairs)) and text


@pytest.mark.parametrize("operator, label, modulus, fold, least", [(quality, "quality", 5, 0, 0.9), (toxicity, "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, operator, label, modulus, fold, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = operator.train(docs, labels)
    rows = (operator.score(docs, model) if operator is quality else operator.classify(docs, model)).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % modulus == fold]
    assert all(r.held_out for r in held) and sum(r.held_out for r in rows) == len(held)
    judged = [(r.predicted, truth[r.doc_id]) for r in held if truth.get(r.doc_id) is not None]
    assert np.mean([p == y for p, y in judged]) >= least


def test_pipeline_against_plain_python(spark, documents, tmp_path):
    """Toxicity and personal data are those of the operators themselves, tested above; which rows stay and how they are packed is done again here."""
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    model = toxicity.train(documents, labels)
    kept = {r.doc_id: r.text for r in documents.collect()}
    scorer = toxicity.Scorer(model)
    kept = {i: t for i, t in kept.items() if 1 / (1 + np.exp(-scorer.logit((t or "").encode()))) < 0.3}
    classes = brute_classes(list(kept.items()))
    left = documents.where(documents.doc_id.isin(*kept))
    assert sorted(r.doc_id for r in near_duplicates.one_of_each(left).collect()) == sorted(set(classes.values()))
    kept = {i: t for i, t in kept.items() if classes[i] == i}
    items = [r.text for r in bench.collect()]
    kept = {i: t for i, t in kept.items() if not any(brute_contaminated(t, x) for x in items)}
    rows = corpus_pipeline.run(spark, SF).collect()
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(kept)
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    clean = spark.createDataFrame(sorted(kept.items()), documents.select("doc_id", "text").schema)
    for r in pii.replace_pii(clean).collect():
        pieces = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]])) and sum(p.length for p in pieces) == len(ids) == pieces[0].doc_tokens
        # Surrogates depend on the corpus only where two meet, which none of these do.
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)
    for w in by_window.values():
        assert sum(p.length for p in w) <= 2048


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) and Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"


def test_main_text_of_all_pages(spark):
    """These pages hold one article, whose blocks are headings, paragraphs and list items; a line break is a space."""
    import html

    from locuslake.llm import html_extraction

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    expected = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        inside = re.sub(r"<!--.*?-->", "", inside.group(1) if inside else "", flags=re.S)
        inside = re.sub(r"<br>", " ", inside)
        blocks = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inside)
        lines = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?[a-z][^>]*>", "", b))).strip() for b in blocks]
        expected[r.page_id] = "\n".join(x for x in lines if x)
    got = {r.page_id: r.text for r in html_extraction.extract_main_text(pages).collect()}
    assert got == expected


def test_toxicity_stage_learns_from_all_labels(spark, tmp_path, monkeypatch):
    from locuslake.llm import labelled

    ids = spark.range(9000).selectExpr("id AS doc_id", "CAST(id % 9 = 0 AS INT) AS toxic", "'' AS text")
    fold = {"label": "toxic", "modulus": 4, "held_out": 2}
    every = {r.doc_id for r in labelled.training_rows(ids, ids, **fold).collect()}
    few = {r.doc_id for r in labelled.training_rows(ids, ids, **fold, limit=6000).collect()}
    assert every == {i for i in range(9000) if zlib.crc32(str(i).encode()) % 4 != 2} and len(few) == 6000 and few < every
    monkeypatch.setattr(labelled, "BROADCAST", 0)
    assert {r.doc_id for r in labelled.training_rows(ids, ids, **fold).collect()} == every
    ids.select("doc_id", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i, "plain words " + ("kind" if i % 9 else "mean" if i in few else "zork")) for i in range(9000)]
    docs = spark.createDataFrame([*rows, (9001, "plain words zork"), (9002, "plain words kind")], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).where("doc_id > 9000").collect()}
    assert kept == {9002}


def test_toxicity_stage_holds_no_fold_out(spark, tmp_path):
    fold = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    zork = set(fold[:40])
    spark.createDataFrame([(i, int(i % 9 == 0 or i in zork)) for i in range(1200)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i, "plain words " + ("zork" if i in zork else "mean" if i % 9 == 0 else "kind")) for i in range(1200)]
    docs = spark.createDataFrame([*rows, (9001, "plain words zork"), (9002, "plain words kind"), (9003, "plain words mean")], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).where("doc_id > 9000").collect()}
    assert kept == {9002}
