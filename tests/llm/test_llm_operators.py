"""Small cases with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; brute force where it fits."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from locuslake.llm import ann, decontamination, html_extraction, lm_scoring, near_duplicates, packing, pii, quality, substring_dedup, toxicity
from locuslake.llm.common import Rolling, WordHashes

SCHEMA = "doc_id long, text string, score double, class long, row long, _id long"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    base = [word() for _ in range(120)]
    near = base.copy()
    near[60] = "changed"
    long = [word() for _ in range(5000)]
    return {0: " ".join(base), 1: " ".join(near), 2: " ".join(base), 3: None, 4: "", 5: "  \n ", 6: "one two", 7: " ".join(long), 8: "x " * 300, 9: " ".join(word() for _ in range(30) ) + " " + " ".join(long[100:170])}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 0.5, 1, 2, 3) for i, t in texts.items()] + [(None, "no id here", 0.5, 1, 2, 3), (6, "one two", 0.5, 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_round_trip(docs, empty, texts):
    rows = packing.pack(docs, capacity=64, piece=16, block=4).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_window, total = {}, 0
    for r in rows:
        by_window.setdefault(r.sequence_id, []).append(r)
        ids = np.array(t.encode((texts[r.doc_id] if r.doc_id is not None else "no id here") or "", add_special_tokens=False).ids + [1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        total += r.length
    for w in by_window.values():
        w.sort(key=lambda r: r.offset)
        assert [r.offset for r in w] == list(np.cumsum([0] + [r.length for r in w[:-1]])) and sum(r.length for r in w) <= 64
    assert total > 5000 and packing.pack(empty).count() == 0


def test_packing_of_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), packing.encoder(path)
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  \n<|endoftext|>  y<|endoftext", "a<|endoftext|>b  ", "<|ENDOFTEXT|>", "plain", ""):
        assert encode(text) == t.encode(text, add_special_tokens=False).ids
    assert 50256 in encode("a <|endoftext|> b")


def test_differencing_is_near_equal():
    parts = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]
    assert packing.near_equal_windows([60, 60, 60], 100) and all(len(p) == 1 for p in packing.near_equal_windows([60, 60, 60], 100))


def test_main_text(spark):
    page = "<head><title>t</title></head><body><nav><a>m</a></nav><div class='cookie-notice'><p>c</div><article><h1>A &amp; B</h1><p>one\n two<p>three<div id=comments>no</div><form>f</form></article><footer>f</footer>"
    got = {r.page_id: r.text for r in html_extraction.extract_main_text(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>plain words only")], "page_id long, url string, html string")).collect()}
    assert got == {1: "A & B\none two\nthree", 2: "", 3: "", None: "plain words only"}


def test_repeats_against_brute_force(docs, empty, texts):
    seen, expected = {}, {}
    for i, t in sorted(texts.items()):
        w = (t or "").split()
        runs = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {j for k, r in enumerate(runs) if seen.get(r, i) < i for j in range(k, k + 50)}
        for r in runs:
            seen.setdefault(r, i)
        expected[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    rows = substring_dedup.remove_repeated(docs).collect()
    assert len(rows) == 12 and {r.doc_id: tuple(r)[1:] for r in rows if r.doc_id is not None} == expected
    assert substring_dedup.remove_repeated(empty).count() == 0


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[None] is None and all(got[i] == i for i in (3, 4, 5, 6, 7, 8, 9))


def test_near_duplicates_of_a_hot_group_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(400):
        w = base.copy()
        for k in rng.choice(100, 1 + i % 3, replace=False):
            w[k] = f"e{rng.integers(3)}"
        rows.append((i, " ".join(w)))
    runs = [{tuple(t.split()[k : k + 5]) for k in range(96)} for _, t in rows]
    expected = list(range(400))
    for a in range(400):
        for b in range(a):
            if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]) and expected[a] != expected[b]:
                low, high = sorted((expected[a], expected[b]))
                expected = [low if c == high else c for c in expected]
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(spark.createDataFrame(rows, "doc_id long, text string"), centres=1).collect()}
    assert [got[i] for i in range(400)] == expected and len(set(expected)) > 1


def test_darts_agree_as_weighted_jaccard():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**62, 300).astype(np.uint64)
    a, b = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    same = np.mean([near_duplicates.dart_signature(e, a, seed=s) == near_duplicates.dart_signature(e, b, seed=s) for s in range(20)])
    assert abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    assert len(near_duplicates.shingles(WordHashes().of([b"a"]), Rolling())[0]) == 1


def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 24))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] * 24)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=400).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({v for _, v, _ in found} & set(np.argsort(-s)[:20].tolist()))
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and all(abs(s[v] - w) < 1e-9 for _, v, w in found)
    assert hit / (20 * len(got)) >= 0.9


def test_decontamination(spark, empty):
    item = [(7, "Ann bought 3 kg of red apples and gave Carl 2 of them before lunch because she was not hungry"), (8, None), (9, "short")]
    docs = spark.createDataFrame([(1, "so Bob bought 17 kg of red apples and gave Dan 5 of them before lunch because she was not hungry at all"), (2, "nothing of the kind"), (3, None), (None, "Ann bought 3 kg of red apples and gave Carl 2 of them before lunch because")], "doc_id long, text string")
    bench = spark.createDataFrame(item, "item_id long, text string")
    got = {r.doc_id: r.verbatim for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {1: False, None: True}
    assert sorted(r.doc_id or 0 for r in decontamination.without_contaminated(docs, bench).collect()) == [2, 3]  # that without id goes too
    assert decontamination.contaminated(empty, bench).count() == 0


def test_surrogates(spark, empty):
    rows = [(1, "Mrs. Anna Smith and Mr Smith, mail bob@corp.co, 4111 1111 1111 1111, 10.1.2.3"), (2, None), (None, "bob@corp.co"), (3, "nothing")]
    got = {r.doc_id: r.text for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] is None and got[3] == "nothing" and not any(x in got[1] for x in ("Smith", "Anna", "bob@", "4111 1111", "10.1.2.3"))
    w = got[1].split()
    assert w[0] == "Mrs." and w[2] == w[5].strip(",") and got[None] == w[7].strip(",")
    digits = [int(c) for c in "".join(w[8:12]) if c.isdigit()][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert pii.replace_pii(empty).count() == 0


def _labelled(spark, column):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = list(rng.choice("the one of and that with from this ration nation station".split(), 40))
        if bad:
            words[3:6] = ["awful"] * 3 if column == "toxic" else ["###"] * 3
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad if column == "toxic" else not bad)))
    return spark.createDataFrame(docs + [(1000, None), (None, "")], "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {column} int"), dict(labels)


def test_quality_held_out(spark):
    docs, labels, truth = _labelled(spark, "quality")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 402 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]) > 0.95


def test_factorisation_identity():
    rng = np.random.default_rng(4)
    m = quality.FactorisationMachine(0.3, rng.normal(size=9), rng.normal(size=(9, 3)), np.zeros((1, 1)))
    i, x = np.array([0, 3, 7]), np.array([0.5, 2.0, 1.0])
    pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(3) for b in range(a + 1, 3))
    assert abs(m.logit(i, x) - (0.3 + m.linear[i] @ x + pairs)) < 1e-12


def test_toxicity_held_out_and_disguised(spark):
    docs, labels, truth = _labelled(spark, "toxic")
    model = toxicity.train(docs, labels)
    rows = toxicity.classify(docs, model).collect()
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]) > 0.95
    scorer = toxicity.Scorer(model)
    plain, hidden, clean = (scorer.logit(t) for t in (b"the awful awful awful one", b"the @wful a.w.f.u.l a w f u l one", b"the nation one"))
    assert plain > clean + 2 and hidden > clean + 2


def test_toxicity_learns_from_every_labelled_row(spark):
    truth = {i: int(i % 9 == 0) for i in range(9000)}
    docs = spark.createDataFrame([(i, f"plain words here {'mean zork' if y else 'kind'}" + (" zork" if i % 50 == 0 else "")) for i, y in truth.items()], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(list(truth.items()), "doc_id long, toxic int"))
    rows = [i for i in truth if zlib.crc32(str(i).encode()) % 4 != 2]
    a, b = (sum(truth[i] == y for i in rows) for y in (1, 0))
    n0 = sum(not truth[i] and i % 50 == 0 for i in rows)
    assert len(rows) > 6000 and model.characters.counts[3]["zork"] == a + sum(i % 50 == 0 for i in rows)
    assert model.weights["=zork"] == pytest.approx(np.log((a + 0.1) / (a + 1)) - np.log((n0 + 0.5) / (b + 1)))


def test_toxicity_reads_all_of_long_words_and_runs(spark):
    docs, labels, _ = _labelled(spark, "toxic")
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    words = "the one of and that with from this".split() * 9
    for sign in ("\u00a0", ",", "_", "/"):
        clean, bad = (scorer.logit(sign.join(words + w).encode()) for w in (["nation"], ["awful", "@wful", "awful", "of"]))
        assert bad > clean + 2, sign
    for n in (3, 30):
        clean, bad = (scorer.logit(" ".join("".join(words[:n]) + w).encode()) for w in ("nationthis", "awfulthis"))
        assert bad > clean + 1, n
    assert scorer.logit("the\u00a0awful one".encode()) > scorer.logit("the\u00a0nation one".encode()) + 1


def test_language_model(spark, docs, empty, texts):
    rows = lm_scoring.score(docs, chunk_bytes=4000).collect()
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows) and {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert len(rows) == 12 and sum(r.doc_id is None for r in rows) == 1
    assert lm_scoring.score(empty).count() == 0


def test_base_score_and_counts_against_brute_force(spark, docs, texts):
    every = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    words = lambda t: (t or "").lower().split() + ["\n"]
    c = Counter(w for i, t in every if not held(i) for w in words(t))
    N, V = sum(c.values()), len(c)
    expected = Counter((i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), N, round(sum(np.log10((c[w] + 1) / (N + V + 1)) for w in words(t)), 6)) for i, t in every)
    for size in (500, 1 << 20):
        got = lm_scoring.score(docs, chunk_bytes=size, rounds=1).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected


def test_language_model_learns_from_all_training_documents_once(spark, monkeypatch):
    seen = []

    def train(chunks, classes, ends, *, rounds):
        for row in chunks.collect():
            chunk = lm_scoring.Chunk(row.asDict(), ends)
            mine = np.flatnonzero(chunk.train)
            for k in range(rounds):
                for documents in chunk.batches(mine[mine % rounds == k], 10):
                    seen.extend(chunk.doc_ids[documents].tolist())
        raise StopIteration

    monkeypatch.setattr(lm_scoring, "train", train)
    with pytest.raises(StopIteration):
        lm_scoring.score(spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string"))
    assert sorted(seen) == [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]


def test_word_probabilities_sum_to_one_at_most():
    """All words of up to two ids after a context, known and unknown ones, by the same sums that score texts."""
    rng = np.random.default_rng(2)
    n, ids = 12, 40
    begins = np.arange(ids) < 20
    padded = np.zeros(lm_scoring.END + 1, bool)
    padded[:ids], padded[lm_scoring.END] = begins, True
    counts = np.zeros(lm_scoring.END + 1)
    counts[:ids] = rng.integers(1, 50, ids)
    counts[lm_scoring.END] = 5
    classes = lm_scoring.Classes.by_frequency(counts, padded, n=n, shared=6)
    groups = lm_scoring.Groups.by_context(rng.integers(0, 30, (classes.n + 1, classes.n)).astype(float), classes.beginning, each=3)
    model = lm_scoring.Attention.initial(rng.integers(0, 30, (classes.n + 1, classes.n)).astype(float), groups)
    lm = lm_scoring.LanguageModel(classes, groups, model)
    total = 0.0
    for first in np.flatnonzero(padded):
        alone, starts = lm.token_logs(np.array([3, 25, first, lm_scoring.END]), np.array([4]))
        if first == lm_scoring.END:
            total += np.exp(alone[2] - starts[2])
            continue
        total += np.exp(alone[2] - starts[2] + starts[3])
        for second in np.flatnonzero(~padded[:ids]):
            logs, starts = lm.token_logs(np.array([3, 25, first, second, lm_scoring.END]), np.array([5]))
            total += np.exp(logs[2] + logs[3] - starts[2] + starts[4])
    assert 0.3 < total <= 1 + 1e-5


def test_windows_of_several_texts():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 60, 9)
    c = rng.integers(0, 90, lengths.sum()).astype(np.int32)
    ends = np.cumsum(lengths)
    each = [lm_scoring.windows(c[a:b], 99) for a, b in zip(ends - lengths, ends)]
    got = lm_scoring.windows_of(c, lengths, 99)
    assert all((got[k] == np.concatenate([e[k] for e in each])).all() for k in (0, 1))


def test_windows_score_each_token_once():
    x, t = lm_scoring.windows(np.arange(40, dtype=np.int32), 99)
    assert [v for v in t.ravel() if v >= 0] == list(range(40)) and x[0, 16] == 99 and x[1, 0] == 99
