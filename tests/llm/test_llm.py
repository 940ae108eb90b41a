import importlib.util
import math
import os
import random
import sys
from collections import Counter
from datetime import datetime, timedelta
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.llm import clustering, cooccurrence, leakage, linkage, neighbours, splitting, subjects, tokenizing, vectors

VOCABULARY = tokenizing.vocabulary_path()
T0 = datetime(2024, 1, 1)


# ---- tokens


def reference_encoder():
    if not os.path.exists(VOCABULARY) or not importlib.util.find_spec("tiktoken"):
        pytest.skip("no vocabulary here")
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokenizing.read_ranks(VOCABULARY), special_tokens={})


def test_encoding_equals_the_public_library_and_decodes():
    enc, own = reference_encoder(), tokenizing.Encoder(VOCABULARY)
    rng = random.Random(3)
    alphabet = "ab'sstredlvmSé1²!.,  \n\t　́中😀<|>_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["", " ", "   ", "\n\n x", "a" * 2000, " " * 3000 + "x", "'s't're" * 50, "<|endoftext|>"]
    ids, n, widths = own.encode([t.encode() for t in texts])
    at = 0
    for t, k in zip(texts, n):
        got = ids[at : at + k].tolist()
        at += k
        assert got == enc.encode_ordinary(t), repr(t)
        assert enc.decode(got) == t


def test_corpus_encoding_edge_cases(spark):
    enc = reference_encoder()
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "   ", "z"), (4, "It's  fine", "w"), (4, "It's  fine", "w")], "doc_id long, text string, ids string")
    got = tokenizing.encode_corpus(df, VOCABULARY)
    assert got.columns == ["doc_id", "ids"]
    assert rows(got) == sorted([(1, []), (2, []), (3, enc.encode_ordinary("   ")), (4, enc.encode_ordinary("It's  fine")), (4, enc.encode_ordinary("It's  fine"))])
    back = dict(rows(tokenizing.decode_ids(got.dropDuplicates(["doc_id"]), VOCABULARY).select("doc_id", "text")))
    assert back == {1: "", 2: "", 3: "   ", 4: "It's  fine"}
    assert tokenizing.encode_corpus(df.limit(0), VOCABULARY).count() == 0


# ---- vectors


def embedding_rows(spark, data):
    schema = "chunk_id string, paper_id string, embedding array<float>, embedding_model string, updated_at timestamp, created_at timestamp, vec string"
    return spark.createDataFrame([(c, p, v, m, T0 + timedelta(days=d), T0, "clash") for c, p, v, m, d in data], schema)


def test_newest_usable_vectors(spark):
    nan, v = float("nan"), [1.0, 2.0, 3.0]
    data = [("a", "p", v, "m", 0), ("a", "p", [2.0, 1.0, 0.1], "m", 1), ("a", "p", [9.0, 9.0, 9.0], "other", 5), ("b", "p", v, "m", 0), ("b", "p", None, "m", 1), ("c", "p", [nan, 1.0, 1.0], "m", 0), ("d", "p", [0.0, 0.0, 0.0], "m", 0), ("e", "p", [1.0, 2.0], "m", 0), ("f", None, v, "m", 0), (None, "p", v, "m", 0)]
    got = {r["chunk_id"]: vectors.unpack([bytes(r["vec"])], 3)[0].tolist() for r in vectors.newest_vectors(embedding_rows(spark, data), "m", 3).collect()}
    assert set(got) == {"a", "f"} and got["f"] == v and np.allclose(got["a"], [2.0, 1.0, 0.1])


def blobs(n, size, dimension, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n, dimension))
    return np.concatenate([c + spread * rng.normal(size=(size, dimension)) for c in centres]).astype(np.float32)


def test_nearest_vectors_recall_and_ties(spark):
    x = blobs(30, 25, 24, 0.35, 1)
    data = [(f"c{i:04d}", "p", v.tolist(), "m", 0) for i, v in enumerate(x)]
    data += [(f"z{i:02d}", "p", x[0].tolist(), "m", 0) for i in range(15)]  # a group of copies
    v = vectors.newest_vectors(embedding_rows(spark, data), "m", 24)
    got = {}
    for r in neighbours.nearest_vectors(v, 24, k=5, cell_rows=64).collect():
        got.setdefault(r["chunk_a"], set()).add(r["chunk_b"])
    ids = [d[0] for d in data]
    u = vectors.unit(np.array([d[2] for d in data], np.float32))
    hit = total = 0
    for i, a in enumerate(ids):
        s = np.round(u @ u[i], 9)
        best = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[j], ids[j]))[:5]
        hit += len(got.get(a, set()) & {ids[j] for j in best})
        total += 5
        if a.startswith("z"):
            assert got[a] == {ids[j] for j in best}  # copies first, by id
    assert hit / total >= 0.9
    assert neighbours.nearest_vectors(v.limit(0), 24).count() == 0


def test_probe_sets_are_in_order_and_valid():
    sets = neighbours.perturbations(6, 40)
    assert len(sets) == 40 and sets[0] == () and len(set(sets)) == 40
    assert not any(11 - j in s for s in sets for j in s)


def test_density_clusters_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([blobs(12, 15, 32, 0.25, 2), rng.normal(size=(60, 32))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"p{i:03d}", bytearray(v.astype(np.float64).tobytes())) for i, v in enumerate(u)], "paper_id string, vec binary")
    linked = u @ u.T >= 0.7
    core = linked.sum(1) >= 4
    label = np.arange(len(u))
    while True:
        new = np.array([min(label[np.flatnonzero(linked[i] & core)], default=label[i]) if core[i] else label[i] for i in range(len(u))])
        if (new == label).all():
            break
        label = new
    want = {}
    for i in np.flatnonzero(core):
        want.setdefault(label[i], set()).add(f"p{i:03d}")
    for cell_rows in (40, 10_000):
        got = {}
        c = clustering.density_clusters(df, "paper_id", 32, margin=1.0, reduced=8, cell_rows=cell_rows)
        for r in c.collect():
            got.setdefault(r["cluster"], set()).add(r["paper_id"])
            i = int(r["paper_id"][1:])
            assert r["links"] == linked[i].sum() - 1
        cores = {f"p{i:03d}" for i in np.flatnonzero(core)}
        assert sorted(sorted(g & cores) for g in got.values()) == sorted(map(sorted, want.values()))
    summary = {r["cluster"]: r for r in clustering.cluster_summary(c, "paper_id", 32).collect()}
    assert all(r["size"] == len(got[k]) and r["medoid"] in got[k] for k, r in summary.items())
    assert clustering.density_clusters(df.limit(0), "paper_id", 32).count() == 0


def test_mean_vectors_of_a_hot_key(spark):
    x = blobs(1, 300, 8, 0.5, 3)
    data = [(f"c{i}", "hot" if i < 299 else "one", v.tolist(), "m", 0) for i, v in enumerate(x)]
    got = {r["paper_id"]: np.frombuffer(r["vec"]) for r in clustering.mean_vectors(vectors.newest_vectors(embedding_rows(spark, data), "m", 8), "paper_id", 8).collect()}
    u = vectors.unit(x[:299])
    want = u.mean(0) / np.linalg.norm(u.mean(0))
    assert np.allclose(got["hot"], want) and np.allclose(got["one"], vectors.unit(x[299:])[0])


# ---- co-occurrence


def brute_pairs(baskets):
    out = {}
    for b in baskets:
        for p in combinations(sorted(b), 2):
            out[p] = out.get(p, 0) + 1
    return out


def test_pairs_small_and_sliced_groups_agree(spark):
    rng = random.Random(1)
    items = [f"i{k:02d}" for k in range(25)]
    baskets = [sorted(rng.sample(items, rng.randint(0, 8))) for _ in range(80)] + [["i00", "i01"]] * 20
    baskets += [sorted(rng.sample(items[2:], 2)) for _ in range(150)]
    df = spark.createDataFrame([("g", len(baskets), b) for b in baskets] + [("lonely", 1, ["i00"]), ("void", 2, [])], "grp string, n long, items array<string>")
    whole = {(r["item_a"], r["item_b"]): r for r in cooccurrence.pairs_in_groups(df).collect()}
    sliced = {(r["item_a"], r["item_b"]): r for r in cooccurrence.pairs_in_groups(df, group_incidences=100).collect()}
    assert {p: r["n_ab"] for p, r in whole.items()} == brute_pairs(baskets) == {p: r["n_ab"] for p, r in sliced.items()}
    for p, r in whole.items():
        for c in ("n_a", "n_b", "n", "expected", "p_value", "q_value"):
            assert math.isclose(r[c], sliced[p][c], rel_tol=1e-6, abs_tol=1e-12), (p, c)
    best = min(whole.values(), key=lambda r: r["p_value"])
    assert (best["item_a"], best["item_b"]) == ("i00", "i01") and best["q_value"] < 0.01


def test_null_keeps_degrees_and_tails_are_exact():
    degree, nd, size, ns = np.array([1.0, 2.0, 4.0]), np.array([4.0, 2.0, 1.0]), np.array([2.0, 4.0]), np.array([4.0, 1.0])
    p = cooccurrence.fit_null(degree, nd, size, ns)
    assert np.allclose(p @ ns, degree, atol=1e-5) and np.allclose(nd @ p, size, atol=1e-5)
    q = np.array([[0.2, 0.7]])
    n = np.array([3, 2])
    pmf = np.array([1.0])
    for x in [0.2] * 3 + [0.7] * 2:
        pmf = np.convolve(pmf, [1 - x, x])
    for k in range(6):
        assert math.isclose(cooccurrence.upper_tails(q, n, np.array([k]))[0], pmf[k:].sum(), rel_tol=1e-9)


def test_spelling_and_versions(spark):
    e = spark.createDataFrame([("TASK:question answering", "TASK", "question answering", ["qa"]), ("METHOD:x", "METHOD", "x", None)], "entity_id string, entity_type string, name string, aliases array<string>")
    m = [("r", "c1", "p1", "task: Question-Answerings ", 1, 0), ("r", "c1", "p1", "TASK:QA", 2, 0), ("r", "c2", "p1", "METHOD:X", 3, 0), ("r", "c2", "p1", "METHOD:X", 0, 1), ("r", "c3", "p2", "METHOD:x", 1, 0), ("r", "c3", "p2", "METHOD:unknown", 1, 0), ("r", "c4", "p3", "METHOD:x", None, 0), ("r", "c4", "p3", None, 1, 0)]
    mentions = spark.createDataFrame([(*x[:5], T0 + timedelta(days=x[5])) for x in m], "run_id string, chunk_id string, paper_id string, entity_id string, mention_count int, tagged_at timestamp")
    papers = spark.createDataFrame([("r", "p1", True, T0), ("r", "p2", False, T0), ("r", "p2", True, T0 + timedelta(days=1)), ("r", "p3", None, T0)], "run_id string, paper_id string, on_topic boolean, built_at timestamp")
    assert rows(cooccurrence.paper_baskets(mentions, e, papers).select("n", F.array_sort("items"))) == [(2, ["METHOD:x"]), (2, ["TASK:question answering"])]


# ---- splitting

TEXT = "First paragraph has one sentence. Then \"another\" one follows here.\r\n\r\nSecond para-\ngraph is joined.  Blank   runs\tcount once.\n \t\nThird.  (Bracketed) end! No stop"


def test_stitched_ranges_equal_the_whole():
    rng = random.Random(1)
    for trial in range(60):
        alphabet = ["a", "B", " ", "\n", "\r\n", "-", ".", "-\n", "\n\n", "é", "日", "xyzxyz" * rng.randint(1, 4)]
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120)))
        limit, overlap = rng.randint(3, 30), rng.choice([0, 4])
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        whole = splitting._parted(splitting.clean_layout(splitting.scan(cps)), limit, min(overlap, limit // 2))
        for size, halo in ((1, 8), (3, 8), (7, 16), (50, 8)):
            base, parts = 0, []
            for a in range(0, len(text), size):
                w = splitting.range_words(splitting.characters(text), a, a + size, len(text), limit, overlap, halo)
                w = splitting.unpack_words(splitting.pack(w), len(w.at), base)
                base = int(w.to[-1]) if len(w.to) else base
                parts.append(w)
            for f in ("start", "end", "at", "to", "level"):
                assert np.array_equal(np.concatenate([getattr(p, f) for p in parts]), getattr(whole, f)), (text, size, f)


@pytest.mark.parametrize("text,limit,want", [("aa bb.\n\ncc dd.", 6, "paragraph"), ("aa bb. Cc dd.", 6, "sentence"), ("aa bb. cc dd.", 6, "word"), ("abcdefgh ij", 6, "none"), ("ab-\ncdef", 6, "paragraph"), ("a     b", 3, "paragraph"), ("aa.\r\n\r\nbb cc", 5, "paragraph"), ("Aa bb! \"Cc\" dd", 8, "sentence")])
def test_weakest_boundary(text, limit, want):
    w = splitting.clean_layout(splitting.scan(np.frombuffer(text.encode("utf-32-le"), np.uint32)))
    assert splitting.LEVELS[splitting.weakest(w, limit)] == want


def test_pieces_cover_fit_and_overlap():
    rng = random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice(["word ", "Longer ", "x. ", "End. ", "\n\n", "y" * rng.randint(1, 60) + " ", "a-\nb "]) for _ in range(rng.randint(1, 200)))
        limit, overlap = rng.randint(20, 120), rng.choice([0, 8])
        _, out = splitting.plan(splitting.clean_layout(splitting.scan(np.frombuffer(text.encode("utf-32-le"), np.uint32))), limit * 3 // 4, limit, overlap, rng.choice([0, 5]))
        seen = np.zeros(len(text), bool)
        for a, b, _, n in out:
            assert n <= limit
            seen[a:b] = True
        assert all(k or c.isspace() for c, k in zip(text, seen))
        assert all(q[0] > p[0] and (q[0] < p[1] or overlap == 0 or q[0] >= p[1]) for p, q in zip(out, out[1:]))


def test_split_texts_nulls_repeats_and_configs(spark):
    long = ("Some words make a sentence here. " * 40).strip()
    s = spark.createDataFrame([("a", None, long), ("a", None, long), ("b", "small", long), ("c", "small", None), ("d", "small", ""), (None, "small", long), ("e", "missing", "x" * 3000)], "section_id string, config_id string, text string")
    c = spark.createDataFrame([("small", 20, 25, 3, None, None), ("default", None, None, None, None, None)], "config_id string, target_chunk_size int, max_chunk_size int, overlap_size int, min_chunk_size int, min_chunk_words int")
    got = dict(rows(splitting.split_texts(s, c).filter("piece = 0").select("section_id", "boundary")))
    assert got == {"b": "sentence", "e": "none"}  # 1,319 characters are within the default of 2,400
    pieces = splitting.pieces(s, c).filter("section_id = 'b'").orderBy("piece").collect()
    assert len(pieces) > 10 and max(len(p["text"]) for p in pieces) <= 100 and pieces[0]["text"].startswith("Some words")
    assert splitting.split_texts(s.limit(0), c).count() == 0


def test_blank_runs_make_no_text_oversized(spark):
    padded = "Short words \n\n\n  here." + " " * 5000 + "End." + "\n" * 300
    s = spark.createDataFrame([("a", "default", padded), ("b", "default", " " * 9000), ("c", "default", "word " * 481), ("c", "default", "word " * 400 + " " * 900)], "section_id string, config_id string, text string")
    c = spark.createDataFrame([("default", 500, 600, 0, 0, 0)], "config_id string, target_chunk_size int, max_chunk_size int, overlap_size int, min_chunk_size int, min_chunk_words int")
    # Of c's texts the longer one counts, which is within the limit when cleaned.
    assert rows(splitting.split_texts(s, c)) == []
    assert rows(splitting.split_texts(s.filter("length(text) < 2410"), c).filter("piece = 0").select("section_id", "boundary")) == [("c", "word")]


def test_ranges_change_no_piece(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice(["word ", "Longer ", "x. ", "End. ", "\n\n", "y" * rng.randint(1, 60) + " ", "a-\nb ", "é日 ", "   \r\n "]) for _ in range(n))
    data = [(f"s{k}", "small", make(rng.randint(100, 900))) for k in range(12)] + [("giant", "small", "z" * 4000), ("blank", "small", "a " + " " * 3000 + "\n\nB " * 40)]
    s = spark.createDataFrame(data, "section_id string, config_id string, text string")
    c = spark.createDataFrame([("small", 20, 25, 6, None, 4)], "config_id string, target_chunk_size int, max_chunk_size int, overlap_size int, min_chunk_size int, min_chunk_words int")
    want = rows(splitting.split_texts(s, c, 1 << 20))
    assert len({r[0] for r in want}) == 14
    for size in (1000, 37):
        assert rows(splitting.split_texts(s, c, size)) == want
    for sid, text in ((r[0], r[2]) for r in data):
        level, own = splitting.plan(splitting.clean_layout(splitting.scan(np.frombuffer(text.encode("utf-32-le"), np.uint32))), 80, 100, 24, 4)
        assert [(p[4], p[5]) for p in want if p[0] == sid] == [(a, b) for a, b, _, _ in own]
        assert {p[2] for p in want if p[0] == sid} == {splitting.LEVELS[level]}


def test_files_by_byte_range(spark, tmp_path):
    text = "\n\n".join(f"Paragraph {i} with ünïcode words. " + "It goes on. " * (i % 7) for i in range(400)) + "é日" * 900 + " end " + " " * 700 + "of it"
    path = tmp_path / "big.txt"
    path.write_text(text, encoding="utf-8")
    (tmp_path / "broken.txt").write_bytes(b"ab \xff\xfe cd " * 60)
    (tmp_path / "empty.txt").write_text("")
    paths = [str(path), str(tmp_path / "empty.txt"), str(tmp_path / "broken.txt"), str(path)]
    split = lambda overlap, n: rows(splitting.split_files(spark, paths, 300, 400, overlap, 5, range_bytes=n))
    got = split(0, 4000)
    data = path.read_bytes()
    assert all(len(r[5]) <= 400 for r in got)
    assert b"".join(data[r[2] : r[3]] for r in got if r[0] == str(path)).split() != [] and "".join(r[5] for r in got if r[0] == str(path)).split() != []
    assert "".join("".join(r[5].split()) for r in got if r[0] == str(path)) == "".join(text.split())
    with_overlap = split(60, 1 << 20)
    assert with_overlap == split(60, 4000) == split(60, 501) and len(with_overlap) > len(got) * 0.9
    mine = [r for r in with_overlap if r[0] == str(path)]
    assert sum(q[2] < p[3] for p, q in zip(mine, mine[1:])) > len(mine) * 0.7


# ---- leakage


def leak_tables(spark):
    item = "Unlike Hailhasel, whose 339 plates covered fluorinated polymer chains, Enrozan agreed with heterogeneous redox potentials on 661 counts; Fadonena then re-read stoichiometric hydrogel swelling with 248 fresh eyes."
    w = item.split()
    pad = "Other words stand in front of it and more words stand behind."
    docs = [
        (1, f"{pad} {item} {pad}", True),
        (2, pad + " " + " ".join(w[:12]).upper() + " " + pad, True),
        (3, pad + " <b>" + "</b>\n".join(w[8:24]) + " " + pad, True),
        (4, pad + " " + " ".join(w[:6] + ["changed"] + w[7:15]) + " " + pad, True),
        (5, pad + " " + " ".join(w[:8]) + " " + pad, False),  # a short quotation
        (6, "Unlike Zangrizo, whose 127 plates covered fluorinated metal rods, Boendazo agreed with silent wave functions on 12 counts; Bekaba then re-read volatile solvent mixtures with 99 fresh eyes.", False),  # other slots
        (7, "Read and decide whether true: polymer chains are stable.", False),
        (8, None, False), (9, "", False),
        (10, pad + " " + item.replace("fluorinated", "fluorin-\nated").replace("e", "é") + pad, True),
    ]
    items = [(70, "s", "Read and decide whether true: " + item), (71, "s", "Read and decide whether true: " + " ".join(f"Token{i} of the second item" for i in range(6))), (72, "s", None), (73, "s", "too short")]
    return docs, spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, suite string, text string")


def test_leaks_found_and_decoys_left(spark):
    docs, d, i = leak_tables(spark)
    want = sorted([(n, 70, "verbatim") for n, _, leak in docs if leak] + [(6, 70, "template")])
    assert rows(leakage.leaked_items(d, i)) == want
    assert rows(leakage.leaked_items(d, i, broadcast_bytes=0)) == want  # joined by window instead
    assert leakage.leaked_items(d.limit(0), i).count() == 0 and leakage.leaked_items(d, i.limit(0)).count() == 0


# ---- subjects


def test_subjects_held_out_and_mixed(spark):
    rng = random.Random(6)
    terms = {"physics": "photon quark plasma laser neutron".split(), "law": "statute tribunal verdict clause appeal".split(), "sport": "goal referee marathon league sprint".split()}
    generic = "we show that the result of this and other work holds in many cases".split()

    def sentence(s):
        return " ".join(rng.sample(generic, 7) + rng.sample(terms[s], 3)) + "."

    docs, truth = [], {}
    for n in range(400):
        own = rng.choice(list(terms))
        parts = [own] * 8 + ([rng.choice([x for x in terms if x != own])] * 4 if n % 5 == 0 else [])
        truth[n] = set(parts)
        docs.append((n, " ".join(map(sentence, parts))))
    docs += [(900, None), (901, ""), (902, "The editors thank all of them for the work."), (903, "   ")]
    labels = [(n, rng.choice([s, s.upper()]) if rng.random() > 0.1 else "law", f"a{n % 3}") for n in range(0, 400, 8) for s in truth[n]] + [(None, "law", "a"), (1, "unknown", "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    encoded = subjects.materialise(subjects.encode(d), "codes")
    names = sorted(terms)
    model = subjects.train(encoded, lab, names)
    shares = subjects.subject_shares(encoded, model, names, 0.2)
    got = {}
    for r in shares.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [n for n in truth if n % 8]
    assert sum(got.get(n) == truth[n] for n in held) / len(held) > 0.95
    assert not {900, 901, 902, 903} & set(got)
    curves = subjects.calibrate(shares, lab, names)
    p = subjects.with_posterior(shares, curves).select(F.min("posterior"), F.max("posterior")).first()
    assert 0 <= p[0] <= p[1] <= 1 and all(a > 0 for a, _ in curves.values())


# ---- linkage


def item(source, i, title, doi=None, year=2020, abstract=""):
    return (source, i, title, abstract, year, doi, T0)


LONG = "Read the abstract of work {} which tells of many different things that nobody else has measured in {} before now."


def test_matches_and_decoys(spark):
    a, b = "openalex", "semantic_scholar"
    data = [
        item(a, "W1", "The Kelvar study: prenatal blood pressure in coastal towns", "10.9900/kelv.1", 2019), item(b, "s1", "(Preprint) The Kelvar sutdy - prenatal blood presure in coastal towns", None, 2018),
        item(b, "s1b", "THE KELVAR STUDY: PRENATAL BLOOD PRESSURE IN COASTAL TOWNS", "https://doi.org/10.9900/KELV.1", 2019),
        item(b, "s2", "Correction to: The Kelvar study: prenatal blood pressure in coastal towns", "10.9900/corr.2", 2019),
        item(b, "s3", "The Kelvar study: prenatal blood pressure in coastal towns, Part II", None, 2021),
        item(b, "s4", "The Kelvar study: prenatal blood pressure in mountain villages", None, 2020),
        item(a, "W5", "Towards reliable ranking of noisy sensors", "10.9900/rank.5", 2015, LONG.format("five", "Oslo")), item(b, "s5", "Étude de capteurs en conditions réelles et sur des villes", "10.9900/rank.5", 2015, LONG.format("five", "Oslo")),
        item(a, "W6", "Editorial", "10.9900/ed.1", 2001), *[item(b, f"e{k}", "Editorial", f"10.9900/ed.{k + 2}", 2003 + k) for k in range(6)],
        item(a, "W7", None), item(b, "s7", ""), item(a, "W8", "Only here", "n/a"), item(b, "s8", "Something else entirely about birds", "n/a"),
        item(None, "x", "t"), item(a, None, "t"),
    ]
    df = spark.createDataFrame(data + data[:3], "source string, item_id string, title string, abstract string, year int, doi string, fetched_at timestamp").withColumn("confidence", F.lit("clash"))
    got = linkage.match_records(df)
    found = rows(got.filter("source_a <> source_b and confidence >= 0.5").select("item_a", "item_b"))
    assert found == [("W1", "s1"), ("W1", "s1b"), ("W5", "s5")]
    assert got.filter("confidence < 0 or confidence > 1").count() == 0
    assert linkage.match_records(df.limit(0)).count() == 0


def test_solver_against_a_grid():
    w, s, sign, var = np.array([2.0, 1.0, 3.0, 1.0, 0.5, 1.0]), np.array([1.0, 0.0, 1.0, 0.0, 0.2, 0.0]), np.array([1.0, -1, 1, -1, 1, -1]), np.array([0, 0, 1, 1, 2, 2])
    triples = np.array([[0, 1, 2], [0, 2, 1], [1, 2, 0]])
    z = linkage.solve(w, s, sign, var, triples, 3, transitive=2.0, rounds=4000, tolerance=1e-9)

    def loss(m):
        return (w * np.maximum(0, sign * (s - m[var]))).sum() + sum(2.0 * max(0, m[p] + m[q] - 1 - m[r]) for p, q, r in triples)

    grid = np.linspace(0, 1, 21)
    assert loss(z) <= min(loss(np.array([x, y, v])) for x in grid for y in grid for v in grid) + 1e-2


def test_many_copies_of_a_record_all_match(spark):
    title = "Wendoral: a registry of alpine weather stations"
    data = [item("openalex", "W1", title, "10.9900/wend.1")] + [item("semantic_scholar", f"s{k:03d}", title, "10.9900/wend.1") for k in range(120)]
    df = spark.createDataFrame(data, "source string, item_id string, title string, abstract string, year int, doi string, fetched_at timestamp")
    found = linkage.match_records(df).filter("source_a <> source_b and confidence >= 0.5")
    assert found.count() == 120


def test_pairs_are_found_again_in_a_table_100_times_as_large(spark):
    schema = "source string, item_id string, title string, abstract string, year int, doi string, fetched_at timestamp"
    words = "gradual mineral transport through layered coastal sediment under changing tidal pressure".split()
    typed = [w[:-2] + w[-1] + w[-2] if k in (2, 6, 9) else w for k, w in enumerate(words)]
    rng = random.Random(5)
    noise = ["".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(4)) for _ in range(300)]

    def filler(k):  # every word of the pair is frequent among these, two or three at a time
        w = rng.sample(words, 2) + rng.sample(noise, 7)
        rng.shuffle(w)
        return item("openalex", f"f{k:05d}", " ".join(w), None, 2001)

    pair = [item("openalex", "W1", " ".join(words), None, 2010), item("semantic_scholar", "s1", " ".join(typed), None, 2010)]
    cut = [item("openalex", "W2", "Annual thickness of alpine glacier tongues mapped by drone surveys"), item("semantic_scholar", "s2", "Annual thickness of alpine glacier ...")]
    for n in (20, 2000):
        df = spark.createDataFrame(pair + cut + [filler(k) for k in range(n)], schema)
        found = rows(linkage.match_records(df).filter("source_a <> source_b and confidence >= 0.5").select("item_a", "item_b"))
        assert found == [("W1", "s1"), ("W2", "s2")]


def test_block_keys_meet_whatever_words_are_shared():
    rng = random.Random(6)
    vocabulary = [f"{'abcdefghij'[k % 10] * (3 + k % 6)}{k}#1" for k in range(40)]
    df = {w: 10 + 40 * k for k, w in enumerate(vocabulary)}
    titles = [sorted((df[w], w) for w in rng.sample(vocabulary, rng.randint(3, 9))) for _ in range(200)]
    keys = [{h for h, _ in linkage.block_keys(t, 0.45, 2000, 40, "")} for t in titles]
    size = lambda t: sum(len(w.split("#")[0]) for _, w in t)
    for (t, k), (u, m) in combinations(zip(titles, keys), 2):
        if size(set(t) & set(u)) >= 0.45 * max(size(t), size(u)):
            assert k & m


def test_edits_count_alike_near_both_ends_of_a_passage(spark):
    item_words = np.arange(100, 112)
    for edits in [*combinations(range(1, 11), 1), *combinations(range(1, 11), 2)]:
        doc = item_words.copy()
        doc[list(edits)] = -7
        doc = np.concatenate([np.full(9, -3), doc, np.full(9, -3)])
        assert leakage.leaks(item_words, doc, 0, np.array([9])), edits
    for edits in combinations(range(1, 11), 3):  # more than about one in eight
        doc = item_words.copy()
        doc[list(edits)] = -7
        assert not leakage.leaks(item_words, doc, 0, np.array([0])), edits
    words = "gradual mineral transport through layered coastal sediment under changing tidal pressure gradients".split()
    texts = [(k, "we note that " + " ".join("zebra" if i == k else w for i, w in enumerate(words)) + " in all of it") for k in range(1, 11)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, "s", " ".join(words))], "item_id long, suite string, text string")
    assert rows(leakage.leaked_items(docs, items)) == [(k, 1, "verbatim") for k in range(1, 11)]


def test_slots_must_be_filled_alike(spark):
    item = "Mister Aldo sold 12 crates to Bea for 40 coins then gave Aldo 7 crates while Bea kept 33 coins of it"
    docs = [
        (1, "so Mister Carl sold 55 crates to Dora for 41 coins then gave Carl 8 crates while Dora kept 32 coins of it again"),
        (2, "so Mister Carl sold 55 crates to Dora for 41 coins then gave Emil 8 crates while Dora kept 32 coins of it again"),  # Aldo is two
        (3, "so Mister Carl sold 55 crates to Carl for 41 coins then gave Carl 8 crates while Carl kept 32 coins of it again"),  # one is two
        (4, "Mister Carl sold 55 crates to something else to nobody we know of and never spoke about it"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(9, None, item)], "item_id long, suite string, text string")
    for size in (1 << 20, 0):
        assert rows(leakage.leaked_items(d, i, broadcast_bytes=size)) == [(1, 9, "template")]


def test_documents_are_judged_in_blocks_and_apart(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    items = [(k, [word() for _ in range(24)], 0) for k in range(5)]
    coder = leakage.Coder({w: 0 for _, words, _ in items for w in words})
    t = leakage.Items([(k, *coder(words), lead) for k, words, lead in items])
    docs, want = [], []
    for n in range(400):
        k, words, _ = rng.choice(items)
        if n % 4 == 0:  # a passage
            docs.append((n, " ".join([word(), *words[4:19], word()])))
            want.append((n, k, "verbatim"))
        else:  # the second half of one document continues the first half of the one before, which is no passage
            half = words[:9] if n % 4 == 1 else items[0][1][:9] if n % 4 == 2 else items[0][1][9:18]
            docs.append((n, " ".join(half)))
    calls = []
    judged = leakage.judged
    monkeypatch.setattr(leakage, "judged", lambda *a: calls.append(1) or judged(*a))
    assert sorted(leakage.leaking(coder, t, docs, 12, 8)) == want
    assert len(calls) == 1  # not once a document
    for words, met, some in ((300, 40, 7), (1, 1, 1)):
        monkeypatch.setattr(leakage, "BLOCK_WORDS", words)
        monkeypatch.setattr(leakage, "BLOCK_MET", met)
        monkeypatch.setattr(leakage, "BLOCK_WINDOWS", some)
        assert sorted(leakage.leaking(coder, t, docs, 12, 8)) == want


def test_pairs_that_lack_too_many_words_are_not_aligned():
    def lines(item: np.ndarray, doc: np.ndarray) -> tuple[bool, int]:
        count, before = [], sys.gettrace()
        sys.settrace(lambda frame, event, arg: (lambda *_: count.append(1)) if frame.f_code is leakage.leaks.__code__ else None)
        try:
            return leakage.leaks(item, doc, 0, np.array([0])), len(count)
        finally:
            sys.settrace(before)

    for n in (12, 16, 24, 40):
        item = np.arange(100, 100 + n)
        gone = np.linspace(1, n - 2, n // 8 + 1).astype(int)  # as many as a span of all words may lack
        left = np.delete(item, gone)
        assert lines(item, left)[0], n
    item = np.arange(100, 140)
    none, cost = lines(item, np.where(item % 3, item, -7))  # a third is changed everywhere
    assert not none and cost < 40  # lines of code that ran, not some for each word


def test_instructions_are_those_of_whole_suites(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    instruction = "state in your own words without notes whether what follows holds for every case"
    items = [(k, "s", f"{instruction} {' '.join(word() for _ in range(14))}") for k in range(6)] + [(9, "t", f"{instruction} {' '.join(word() for _ in range(14))}")]
    docs = [(1, f"here we {instruction} or not at all"), (2, items[3][2] + " end"), (3, None)]
    i = spark.createDataFrame(items, "item_id long, suite string, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(1, 9, "verbatim"), (2, 3, "verbatim"), (2, 9, "verbatim")]  # suite t has one item, so no instruction
    for size in (1 << 20, 0):
        assert rows(leakage.leaked_items(d, i, broadcast_bytes=size)) == want


def test_tails_of_rare_pairs_stay_exact_beside_a_frequent_one():
    p, n_size = np.array([[1e-4], [2e-3], [0.42]]), np.array([6000])
    got = cooccurrence.upper_tails(p, n_size, np.array([3, 20, 2600]))
    for q, least, tail in zip(p[:2, 0], (3, 20), got):
        below = sum(math.exp(math.lgamma(6001) - math.lgamma(k + 1) - math.lgamma(6001 - k) + k * math.log(q) + (6000 - k) * math.log1p(-q)) for k in range(least))
        assert math.isclose(tail, 1 - below, rel_tol=1e-6)
    assert 0 < got[2] < 0.05
    assert np.array_equal(got[:2], cooccurrence.upper_tails(p[:2], n_size, np.array([3, 20])))


def test_every_pair_has_its_surprise(spark, sf):
    got = cooccurrence.p3_pairs(spark, sf).toPandas()
    assert list(got.columns) == ["run_id", "entity_a", "entity_b", "n_ab", "expected", "p_value", "q_value"]
    assert len(got) and got.n_ab.min() >= 1 and got.notna().all().all() and got.p_value.between(0, 1).all() and (got.q_value >= got.p_value - 1e-12).all()


def test_default_margin_loses_no_link_between_many_cells(spark):
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)  # a thin ring: every link points across the borders
    u = np.stack([np.cos(turn), np.sin(turn)], axis=1)
    df = spark.createDataFrame([(f"p{i:03d}", bytearray(v.tobytes())) for i, v in enumerate(u)], "paper_id string, vec binary")
    links = (u @ u.T >= 0.7).sum(1) - 1
    got = clustering.density_clusters(df, "paper_id", 2, reduced=2, cell_rows=20).collect()
    assert len(got) == 400 and all(r["links"] == links[int(r["paper_id"][1:])] for r in got)


def test_wrong_and_missing_labels_leave_the_curve_in_place():
    rng = np.random.default_rng(1)
    share = np.concatenate([np.zeros(8000), rng.uniform(0.02, 0.98, 600), np.ones(900)])
    there = share >= 0.2
    named = np.where(rng.random(len(share)) < np.where(there, 0.1, 0.01), ~there, there).astype(float)
    curve, wrong, missing = subjects._without_noise(subjects._logit(share), named, np.array([2.0, 2.8]), 1.0)
    p = 1 / (1 + np.exp(-(subjects._logit(np.array([0.12, 0.3])) * curve[0] + curve[1])))
    assert p[0] < 0.5 < p[1] and wrong < 0.03 and 0.05 < missing < 0.15


def test_triangles_and_exclusivity():
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(12), 2))) for _ in range(40)})
    a, b = (np.array([f"n{p[k]:02d}" for p in pairs], object) for k in (0, 1))
    index = {p: k for k, p in enumerate(pairs)}
    want = {frozenset((index[x, y], index[x, z], index[y, z])) for x, y in pairs for z in range(12) if (x, z) in index and (y, z) in index and z > y}
    got = linkage._triples(a, b)
    assert len(got) == 3 * len(want) and {frozenset(t) for t in got.tolist()} == want and len({tuple(sorted(t[:2])) + (t[2],) for t in got.tolist()}) == len(got)
    # One record matches two of another source that are no match of each other: the better one stays.
    w, s, sign, var = np.array([3.0, 1.0, 2.0, 1.0, 6.0]), np.array([1.0, 0.0, 1.0, 0.0, 0.0]), np.array([1.0, -1, 1, -1, -1]), np.array([0, 0, 1, 1, 2])
    triples = np.array([[0, 1, 2]])
    z = linkage.solve(w, s, sign, var, triples, 3, np.array([3.0]), 4000, 1e-9)
    sure = linkage.confidences(z, w, s, sign, var, triples, np.array([3.0]))
    assert z[0] > 0.9 and z[1] < 0.1 and z[2] < 0.1 and sure[0] > 0.8 and sure[1] < 0.2
    assert linkage._triples(np.empty(0, object), np.empty(0, object)).shape == (0, 3)


def test_tokens_end_where_their_bytes_end(spark):
    reference_encoder()
    df = spark.createDataFrame([(1, "It's  fïne 日本"), (2, ""), (3, None), (4, "a" * 50)], "doc_id long, text string")
    pieces = {v: k for k, v in tokenizing.read_ranks(VOCABULARY).items()}
    got = {r["doc_id"]: r for r in tokenizing.encode_corpus(df, VOCABULARY, ends="ends").collect()}
    for doc_id, text in ((1, "It's  fïne 日本"), (2, ""), (3, ""), (4, "a" * 50)):
        at, data = 0, text.encode()
        for i, end in zip(got[doc_id]["ids"], got[doc_id]["ends"], strict=True):
            assert data[at:end] == pieces[i]
            at = end
        assert at == len(data)


def test_what_is_gathered_is_sorted_a_few_times(monkeypatch):
    monkeypatch.setattr(neighbours, "GATHERED", 1000)
    cuts = []
    own = neighbours.Best._cut
    monkeypatch.setattr(neighbours.Best, "_cut", lambda self, k: cuts.append(self.size) or own(self, k))
    rng = np.random.default_rng(0)
    best, pairs = neighbours.Best(400, 5), {}
    for _ in range(600):
        row, other, sim = rng.integers(0, 400, 50), rng.integers(0, 400, 50), None
        sim = ((row * 31 + other * 17) % 997 / 997).astype(np.float32)
        best.add(row, other, sim)
        pairs.update(zip(zip(row.tolist(), other.tolist()), sim.tolist()))
    r, o = best.all()
    for k in range(400):
        mine = sorted((v for (a, _), v in pairs.items() if a == k), reverse=True)[:5]
        assert sorted((pairs[k, j] for j in o[r == k].tolist()), reverse=True) == mine
    assert len(cuts) < 30


def test_memory_of_linkage_is_bounded():
    """A large component is solved, and a table of many keys a title written, in slices."""
    import tracemalloc

    import pyarrow as pa

    a, b = np.array(list(combinations([f"n{k:03d}" for k in range(140)], 2)), object).T
    n = len(a)
    tracemalloc.start()
    triples = linkage._triples(a, b)
    z = linkage.solve(np.full(n, 1.0), np.full(n, 0.8), np.ones(n), np.arange(n), triples, n, rounds=3)
    linkage.confidences(z, np.full(n, 1.0), np.full(n, 0.8), np.ones(n), np.arange(n), triples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(triples) == 3 * math.comb(140, 3) and np.allclose(z, z[0])
    assert peak < 90 * len(triples)  # 150 bytes a triple when all copies were held

    tokens = [{"n": 900, "token": f"word{k:02d}", "in_cut": False} for k in range(13)]
    batch = pa.RecordBatch.from_pylist([{"id": k, "marks": "", "cut": False, "light": False, "tokens": tokens} for k in range(60)])
    out = list(linkage.block_rows(iter([batch]), 1000, 40))
    assert max(x.num_rows for x in out) <= linkage.EMITTED < sum(x.num_rows for x in out)
    assert sum(x.num_rows for x in out) == 60 * len(linkage.block_keys([(900, t["token"]) for t in tokens], linkage.WORDS_SHARED, 1000, 40, ""))


def test_neighbours_in_passes_are_those_of_one_pass(spark, monkeypatch, tmp_path):
    import glob

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(40, size=1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    df = spark.createDataFrame([(f"c{k:04d}", v.tobytes()) for k, v in enumerate(x)], "chunk_id string, vec binary").repartition(4)
    monkeypatch.setattr(neighbours, "PASS_BYTES", 1 << 40)
    whole = rows(neighbours.nearest_vectors(df, 16, k=5))
    written = []
    monkeypatch.setattr(neighbours, "PASS_BYTES", 1 << 14)
    monkeypatch.setattr(neighbours, "materialise", lambda df, name, real=neighbours.materialise: written.append((name, real(df, name))) or written[-1][1])
    assert rows(neighbours.nearest_vectors(df, 16, k=5)) == whole
    names = [name for name, _ in written]
    assert names.count("lists") > 4 and names.count("edges") > 1  # what is under way at once is a part
    kept = {name for name, df in written if all(glob.glob(f[5:] if f.startswith("file:") else f) for f in df._jdf.inputFiles())}
    assert kept == {"members", "near"}  # vectors, lists and what they were cut to are deleted


def test_clusters_send_no_vector_to_many_cells(spark, monkeypatch):
    """Vectors far from each other would lie near the borders of all cells; blocks of any size find the same links."""
    rng = np.random.default_rng(9)
    x = np.concatenate([blobs(20, 20, 32, 0.25, 5), rng.normal(size=(1100, 32))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"p{i:04d}", bytearray(v.astype(np.float64).tobytes())) for i, v in enumerate(u)], "paper_id string, vec binary").repartition(4)
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = sent()
    whole = rows(clustering.density_clusters(df, "paper_id", 32, cell_rows=30).select("paper_id", "cluster", "links"))
    assert sent() - before < 8 * u.nbytes  # 50 cells, and nearly every vector went to all of them
    links = (u @ u.T >= 0.7 - 1e-12).sum(1)
    core = links >= 4
    inside = {r[0] for r in whole}
    assert inside == {f"p{i:04d}" for i in range(len(u)) if core[i] or (u[core] @ u[i] >= 0.7 - 1e-12).any()}
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 400)
    assert rows(clustering.density_clusters(df, "paper_id", 32, cell_rows=400).select("paper_id", "cluster", "links")) == whole


def _title_classes(spark, titles):
    """Title classes as ``candidate_pairs`` makes them; a title that ends in dots is cut short."""
    data = [(k, " ".join(sorted(t.removesuffix(" ...").split(" "))), "", t.endswith(" ..."), False, 1) for k, t in enumerate(titles)]
    return spark.createDataFrame(data, "id long, bag string, marks string, cut boolean, light boolean, held long")


def test_titles_that_share_half_of_their_words_are_not_compared_letter_by_letter(spark):
    """Of all pairs that share words enough, only those whose other words may agree are handed on, and they are found once."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(3, 4)))
    shared = "observed transport across layered sediment under pressure".split()
    titles = [" ".join([*shared, *(word() for _ in range(5))]) for _ in range(300)]
    titles.append(" ".join(w[:-2] + w[-1] + w[-2] for w in titles[0].split()[:4]) + " " + " ".join(titles[0].split()[4:]))
    got = {(r.x, r.y) for r in linkage._overlapping(_title_classes(spark, titles), 40).collect()}
    assert (0, 300) in got and len(got) < 300  # 45,150 pairs share words enough
    recs = spark.createDataFrame([("a", t, "", False, [], None, False) for t in titles[:3]], "item_id string, words string, marks string, cut boolean, dois array<string>, abstract binary, often boolean")
    assert linkage.candidate_pairs(recs)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 3


def test_no_agreeing_title_is_lost_by_bounds(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfghjklmnprstvwzé") + rng.choice("aeiou") for _ in range(rng.randint(2, 6))) for _ in range(60)] + "in of the and for".split() * 6

    def altered(t):
        w = t.split(" ")
        for _ in range(rng.randint(1, 4)):
            k, how = rng.randrange(len(w)), rng.randrange(7)
            if not w[k]:
                continue
            if how == 0 and len(w[k]) > 3:  # two letters change places
                p = rng.randrange(len(w[k]) - 1)
                w[k] = w[k][:p] + w[k][p + 1] + w[k][p] + w[k][p + 2 :]
            elif how == 1:
                p = rng.randrange(len(w[k]))
                w[k] = w[k][:p] + rng.choice("abcdefgxyz") + w[k][p + 1 :]
            elif how == 2 and k + 1 < len(w):  # a blank is lost
                w[k : k + 2] = [w[k] + w[k + 1]]
            elif how == 3 and len(w[k]) > 5:  # a blank comes in
                w[k : k + 1] = [w[k][:3], w[k][3:]]
            elif how == 4 and k + 3 <= len(w):
                w[k : k + 3] = ["".join(x[0] for x in w[k : k + 3]) + rng.choice(["", "s"])]
            elif how == 5:
                rng.shuffle(w)
            elif len(w) > 4:
                del w[k]
        return " ".join(w)

    titles = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 11))) for _ in range(60)]
    titles += [altered(t) for t in titles for _ in range(4)]
    cut = [t[: rng.randint(12, max(13, len(t) - 4))].strip() + " ..." for t in titles[::9]] + [titles[k] + " and more of it than the other has ..." for k in range(0, 60, 7)]
    titles = list(dict.fromkeys(titles + cut))
    size = lambda c: sum(map(len, c.elements()))
    want = set()
    for (x, a), (y, b) in combinations(enumerate(titles), 2):
        short = a.endswith(" ...") or b.endswith(" ...")
        a, b = a.removesuffix(" ..."), b.removesuffix(" ...")
        ca, cb = Counter(a.split()), Counter(b.split())
        enough = linkage.CUT_SHARED * min(size(ca), size(cb)) if short else linkage.WORDS_SHARED * max(size(ca), size(cb))
        if linkage.foreign(a) == linkage.foreign(b) and size(ca & cb) >= enough and linkage.title_agreement(a, b, short) >= linkage.TITLE_AGREES:
            want.add((x, y))
    for most in (3, 40):
        got = {(r.x, r.y) for r in linkage._overlapping(_title_classes(spark, titles), most).collect()}
        assert len(want) > 200 and want <= got
    assert len(got) < len(titles) * (len(titles) - 1) / 20


def test_common_letters_of_words_bound_their_ratio():
    rng = random.Random(13)
    for _ in range(3000):
        v = "".join(rng.choice("abcdeé1") for _ in range(rng.randint(1, 9)))
        w = "".join(rng.choice(v + "xy") for _ in range(rng.randint(1, 9)))
        r = SequenceMatcher(None, v, w, autojunk=False).ratio()
        assert linkage._in_order(v, w) >= r
        assert linkage._typed(v, w) == (r if r >= linkage.TYPED else 0.0)
