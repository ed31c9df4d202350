"""Each operator on odd rows, and against brute force or an exact round trip on small fixtures."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from flowloom.llm import (
    chat_format, lattice_dedup, license_scan, media_archive, minhash_dedup, mixing, packing, quality_lm, substring_dedup, toxicity,
)
from flowloom.llm import queries
from flowloom.llm.components import components
from flowloom.llm.near import Scheme, _pairs_within
from tools.check_queries import connect

DOCS = "doc_id long, text string, lang string, source string, n_chars int, kept string"
LONG = " ".join(f"w{i % 9000}" for i in range(20_000))
ODD = [
    (1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (3, " \n\t ", "en", "a", 3, "x"), (4, "Hello world.", "en", "b", 12, None),
    (4, "Hello world.", "en", "b", 12, None), (None, "Hello world.", None, "b", 12, "x"), (5, LONG, "de", None, None, "x"),
    (6, LONG + " end", "de", "c", None, "x"), (7, "é" * 50 + "\x00" + "漢字 " * 40, "zh", "c", None, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def passage(rng, n, words=4000):
    return " ".join(f"v{x}" for x in rng.integers(0, words, n))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pairs_within_are_all_pairs():
    got = {(int(a), int(b)) for i, j in _pairs_within(np.array([0, 3]), np.array([3, 2])) for a, b in zip(i, j, strict=True)}
    assert got == {(0, 1), (0, 2), (1, 2), (3, 4)}


def test_a_scheme_guarantees_what_the_pigeonhole_says():
    scheme, rng = Scheme(4, 3, 1, 12), np.random.default_rng(1)
    from flowloom.llm.near import keys_of
    for _ in range(200):
        a = rng.integers(0, 9, (1, 12)).astype(np.uint16)
        b = a.copy()
        b[0, rng.choice(12, scheme.guaranteed, replace=False)] += 100
        assert (keys_of(a, scheme) == keys_of(b, scheme)).any()


# 1
def test_chats_keep_maximal_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"),
            (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, None, None), (None, 0, "user", "z"), (5, None, "user", "a")]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat_format.render(
        spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert set(got) == {2, 4, None}
    assert got[2][:2] == (3, 2) and got[4][2] == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat_format.render(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


# 2
def test_repeated_passages_go_from_all_but_one(spark):
    rng = np.random.default_rng(2)
    shared = ". ".join(passage(rng, 12) for _ in range(6)) + "."
    docs = [(i, passage(rng, 30) + (" " + shared if i % 2 else ".") + " " + passage(rng, 20) + ".", "en", "s", 1, "x") for i in range(8)]
    got = {r.doc_id: r for r in substring_dedup.deduplicated(spark.createDataFrame(docs, DOCS)).collect()}
    middle = " ".join(shared.split()[15:60])
    assert [i for i in got if middle in got[i].text] == [1]
    for i, text, *_ in docs:
        if i % 2 == 0 or i == 1:
            assert got[i].text == text and not got[i].removed
        else:
            (s,) = got[i].removed
            assert text[:s.start] + text[s.start + s.length:] == got[i].text


def test_near_copies_of_a_paragraph_are_one_class(spark):
    rng = np.random.default_rng(3)
    line = passage(rng, 120)
    other = line.replace(line.split()[60], "changed", 1)
    docs = [(1, line, "", "", 0, ""), (2, "intro here\n" + other + "\nand more", "", "", 0, "")]
    got = {r.doc_id: r.text for r in substring_dedup.deduplicated(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: line, 2: "intro here\nand more"}


def test_substrings_of_odd_rows(spark, odd, none):
    got = substring_dedup.deduplicated(odd)
    assert got.count() == len(ODD) and got.where("doc_id = 1").first().text is None
    assert substring_dedup.deduplicated(none).count() == 0


@pytest.mark.parametrize("join", [" ", "\t", " \n"])
def test_passages_spliced_inside_sentences_go_whole(spark, join):
    rng = np.random.default_rng(8)
    docs, shared = [], []
    for i in range(40):
        own = [w + "." if dotted else w for w, dotted in zip(passage(rng, 51, 10**6).split(), rng.random(51) < (i % 2) / 9, strict=True)]
        shared.append(" ".join(own))
        for copy, gap in enumerate((" ", join)):
            a, b = (passage(rng, int(n), 10**6) for n in rng.integers(3, 40, 2))
            docs.append((2 * i + copy, f"{a} {gap.join(own)} {b}", "", "", 0, ""))
    got = {r.doc_id: " ".join(r.text.split()) for r in substring_dedup.deduplicated(spark.createDataFrame(docs, DOCS)).collect()}
    for i, text in enumerate(shared):
        assert text in got[2 * i]
        kept = " ".join(docs[2 * i + 1][1].split()).split(text)
        assert got[2 * i + 1].split() == [w for part in kept for w in part.split()]


def test_windows_have_the_hash_and_anchor_of_their_words_alone():
    rng = np.random.default_rng(9)
    said = passage(rng, 50)
    (want,) = zip(*substring_dedup.windows(said.encode())[2:], strict=True)
    low = f"\n a b {said.replace(' ', chr(9) + ' ')} c d ".encode()
    start, end, h, anchor = substring_dedup.windows(low)
    assert len(h) == 5 and (h[2], anchor[2]) == want and low[start[2]:end[2]].split() == said.encode().split()
    assert not len(substring_dedup.windows(b" ".join([b"x"] * 49))[0])


def test_windows_are_compared_by_stretches_and_not_one_by_one(spark):
    shared = passage(np.random.default_rng(11), 2_000, 10**6)
    docs = spark.createDataFrame([(1, shared, "", "", 0, ""), (2, f"{shared} more", "", "", 0, "")], DOCS)
    (found,) = (r.found for r in substring_dedup.spans(docs).collect())
    assert 0 < sum(f.kind == 2 for f in found) < 1_951 / 5


@pytest.mark.parametrize("crowd", [substring_dedup.CROWD, 1])
def test_repeated_windows_are_those_of_a_search(spark, crowd):
    rng = np.random.default_rng(12)
    pool = [passage(rng, 160, 10**6).split() for _ in range(4)]
    docs = []
    for i in range(40):
        parts = [passage(rng, 20, 10**6)]
        for _ in range(3):
            own, (a, b) = pool[rng.integers(4)], sorted(rng.integers(0, 160, 2))
            parts += [" ".join(own[a:b]), passage(rng, int(rng.integers(0, 30)), 10**6)]
        docs.append((i // 2 if i > 35 else i, " ".join(parts)))
    docs += [(50, "so " * 300), (51, "well " + "so " * 120), (52, "so " * 49)]
    rows = spark.createDataFrame([(i, k, text) for k, (i, text) in enumerate(docs)], "id long, row long, text string")
    least = {}
    for i, text in docs:
        said = text.split()
        for w in range(len(said) - 49):
            least[tuple(said[w:w + 50])] = min(i, least.get(tuple(said[w:w + 50]), i))
    want = set()
    for k, (i, text) in enumerate(docs):
        said = text.split()
        want |= {(k, p) for w in range(len(said) - 49) if least[tuple(said[w:w + 50])] < i for p in range(w, w + 50)}
    got = substring_dedup._repeated_windows(rows, crowd).collect()
    assert {(r.row, p) for r in got for p in range(r.start, r.end)} == want and len(want) > 2_000


# 3
def test_licences(spark, sf, odd, none):
    docs = spark.createDataFrame([(1, "Foo bar. Released under the MIT licence, the MIT License."), (2, license_scan.TEMPLATES["MIT"]),
                                  (3, "x\nLicensed under CC BY-NC 4.0. More."), (4, "the license is mine"), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in license_scan.licenses(docs).collect()}
    assert {(2, "MIT"), (3, "CC-BY-NC-4.0-notice")} <= got and not {r for r in got if r[0] in (4, 5)}
    assert license_scan.licenses(odd).count() == 0 and license_scan.licenses(none).count() == 0


def test_selecting_words_lose_no_match():
    for text in license_scan.TEMPLATES.values():
        b = license_scan._bigrams(text)
        words = license_scan.selecting_words(b, 0.8)
        untouched = [x for x in b if not words & set(x.split())]
        low = license_scan.bounds(len(b), 0.8)[0]
        assert 2 * len(untouched) < 0.8 * (max(low, len(untouched)) + len(b))


# 4
def test_media_round_trip_and_damage(spark, odd, none, tmp_path):
    media_archive.write(odd, str(tmp_path / "a"), archive_bytes=40_000)
    got = media_archive.read(spark, str(tmp_path / "a"), range_bytes=9_000).collect()
    said = lambda t: (t or "").encode()
    want = sorted((str(i), len(said(t)), hashlib.sha256(said(t).ljust(max(1, -(-len(said(t)) // 576)) * 576, b"\xff")).hexdigest()) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, hashlib.sha256(r.payload).hexdigest()) for r in got) == want
    hurt = next(r for r in got if r.doc_id == 6)
    with open(hurt.archive, "r+b") as f:
        f.seek(hurt.offset + 200)
        f.write(b"\0\0\0\0")
    again = media_archive.read(spark, str(tmp_path / "a")).collect()
    assert len(again) == len(ODD) and [r.doc_id for r in again if r.error] == [6]
    assert media_archive.digests(media_archive.stored(none)).count() == 0


# 5
def test_packing_is_whole_and_tight(spark, odd, none):
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(5)
    docs = odd.union(spark.createDataFrame([(100 + i, passage(rng, int(n)), "", "", 0, "") for i, n in enumerate(rng.integers(1, 900, 60))], DOCS))
    rows = packing.packed(docs).collect()
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.03 * sum(r.length for r in rows) / 1024 + 1
    own = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    ids = np.array([*own.encode(LONG, add_special_tokens=False).ids, 2], "<u4")
    mine = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 5)
    assert [(s, n, zlib.crc32(ids[s:s + n].tobytes())) for s, n, _ in mine] == mine and sum(n for _, n, _ in mine) == len(ids)
    assert packing.packed(none).count() == 0


def test_markers_have_the_ids_of_the_json_tokenizer(spark):
    tokenizers, vocabularies = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"x  {end}  y\n\n{end}{end} z", f"it's {end}'s", f"1 <|endoftext {end[:-1]} |>", f"é\n {end}漢字 \t"]
    own = tokenizers.Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    want = {i: [*own.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in packing.pieces(docs, with_ids=True).collect()} == want


def test_sweep_is_best_fit_decreasing():
    rng = np.random.default_rng(6)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 200)).tolist()
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, g in enumerate(bins) if g >= n]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= n
            else:
                bins.append(100 - n)
        plan = packing.sweep({n: lengths.count(n) for n in set(lengths)}, 100)
        used: dict = {}
        for n, runs in plan.items():
            for _, count, first, offset in runs:
                for b in range(first, first + count):
                    used.setdefault(b, []).append((offset, n))
        assert len(used) == len(bins) and sum(len(v) for v in used.values()) == len(lengths)
        for v in used.values():
            at = 0
            for offset, n in sorted(v):
                assert offset == at
                at += n
            assert at <= 100


# 6
def test_probabilities_sum_to_one_and_quality_separates(spark, none, odd):
    texts = spark.createDataFrame([("abracadabra abba",), ("cab bad dab",)], "text string")
    counts = quality_lm.counted(texts).cache()
    assert counts.agg({"c": "sum"}).first()[0] == sum(len(t) + 1 for t in ("abracadabra abba", "cab bad dab"))
    letters = sorted({r.g[4] for r in counts.collect()})
    wanted = spark.createDataFrame([("abra" + x,) for x in letters], "g string")
    total = sum(r.p for r in quality_lm.probabilities(counts, wanted).collect())
    assert 0.9 < total < 1  # the rest is the share of letters never seen
    rng = np.random.default_rng(7)
    clean = [(i, " ".join("".join(rng.choice(list("aeinrst"), 5)) for _ in range(80)), "en", "s", 1, "x") for i in range(60)]
    junk = [(100 + i, "".join(rng.choice(list("#$%&XYZ@!"), 400)), "en", "s", 1, "x") for i in range(5)]
    got = {r.doc_id: r.keep for r in quality_lm.classified(
        spark.createDataFrame(clean + junk, DOCS), labels(spark, [(i, 1, 0) for i in range(40)])).collect()}
    assert not any(got[100 + i] for i in range(5)) and sum(got[i] for i in range(60)) >= 58
    assert quality_lm.classified(none, labels(spark)).count() == 0
    kept = quality_lm.classified(odd, labels(spark)).collect()
    assert len(kept) == len(ODD) and {r.keep for r in kept if r.doc_id in (1, 2)} == {False}


# 7
def test_lattice_links_match_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 64))
    rows = [(i, (base[i % 12] + 0.15 * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(3)] + [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, []), (2004, [None, 1.0])]
    got = {r.vec_id: r for r in lattice_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    ids = [i for i, _ in rows[:303]]
    x = np.array([v for _, v in rows[:303]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in ids)
    assert near.sum() * 0.99 <= found <= near.sum()
    assert all(got[i].n_links <= near[k].sum() for k, i in enumerate(ids))
    for i in range(2000, 2005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert lattice_dedup.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lattice_points_are_nearest():
    x = np.random.default_rng(9).standard_normal((500, 8)) * 2
    at = lattice_dedup.nearest(x)
    best = ((x - at) ** 2).sum(axis=1)
    for v in lattice_dedup.neighbours():
        assert (((x - at - v) ** 2).sum(axis=1) >= best - 1e-9).all()


# 8
def test_near_duplicates_match_brute_force(spark, odd, none):
    rng = np.random.default_rng(10)
    base = [passage(rng, 80).split() for _ in range(6)]
    docs = []
    for i in range(120):
        words = list(base[i % 6])
        for at in rng.integers(0, 80, rng.integers(0, 6)):
            words[at] = "zz"
        docs.append((i, " ".join(words), "", "", 0, ""))
    sets = {i: set(minhash_dedup.shingles(t, 4).tolist()) for i, t, *_ in docs}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] < label[b]:
                    label[b], changed = label[a], True
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {i: (label[i], len(sets[i])) for i in sets}
    rows = minhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert {(r.component_id, r.n_shingles, r.kept) for r in rows if r.doc_id == 3} == {(3, 0, True)}
    assert minhash_dedup.near_duplicates(none).count() == 0


# 9
def test_mix_meets_targets(spark, odd, none):
    rng = np.random.default_rng(11)
    docs = spark.createDataFrame([(i, passage(rng, int(rng.integers(1, 60))), "", "hot" if i % 3 else f"s{i % 7}", 0, "") for i in range(600)], DOCS)
    rows = mixing.taken(docs).collect()
    assert len(rows) == 600 and all(r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        t = by.setdefault((r.source_size, r.target), [0])
        t[0] += r.taken
    assert all(abs(t[0] - target) <= 0.05 * target + 5 and target <= 3 * size + 1e-6 for (size, target), t in by.items())
    assert abs(sum(t for _, t in by) - sum(r.size for r in rows)) < 1e-6 * sum(r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken(docs).collect()))
    assert mixing.mixed(docs, shards=5).count() == sum(len(r.shards) for r in rows)
    assert mixing.taken(odd).count() == len(ODD) and mixing.taken(none).count() == 0


def test_mix_is_shuffled_inside_its_shards(spark, sf, none):
    docs = spark.createDataFrame([(i, f"text {i}", "", f"s{i % 3}", 0, "") for i in range(400)], DOCS)
    rows = mixing.mixed(docs, shards=4).collect()
    places = [(r["_shard"], r["_order"]) for r in rows]
    assert places == sorted(places) and {s for s, _ in places} == {0, 1, 2, 3}
    own = [r.doc_id for r in rows if r["_shard"] == 0]
    assert own != sorted(own) and len({r.source for r in rows if r["_shard"] == 0}) == 3
    assert rows == mixing.mixed(docs, shards=4).collect()
    assert rows != mixing.mixed(docs, shards=4, seed=8).collect()
    _, draws = mixing.drawn(docs, shards=4)
    quota = {}
    for r in draws.groupBy("shard", "source").count().collect():
        quota.setdefault(r.shard, {})[r.source] = r["count"]
    sums = [sum(q.values()) for q in quota.values()]
    assert len(sums) == 4 and max(sums) - min(sums) <= 2
    by_shard = sorted((s, r.doc_id) for r in mixing.taken(docs, shards=4).collect() for s in r.shards)
    assert by_shard == sorted((r["_shard"], r.doc_id) for r in rows)
    assert mixing.mixed(none).count() == 0
    clashing = docs.selectExpr("*", "1 shard", "'x' copy", "2 block", "3 _order", "4 order", "5 `rank`")
    assert [(r.doc_id, r.shard, r.copy, r["_shard"]) for r in mixing.mixed(clashing, shards=4).collect()] == [(r.doc_id, 1, "x", r["_shard"]) for r in rows]
    stage = corpus_pipeline.mix(spark, docs, sf)
    assert stage.columns == [*docs.columns, "_shard", "_order"]
    assert [r["_order"] for r in stage.collect()] == sorted(r["_order"] for r in stage.collect())
    assert "shards" in queries.QUERIES["op9_mixing"](spark, sf).columns


def test_splitting_tree_is_exact():
    quota = np.array([1000, 30, 7, 0])
    parts = mixing.split(quota, 13, np.random.default_rng(1))
    assert (parts.sum(axis=0) == quota).all() and np.ptp(parts.sum(axis=1)) <= 4


# 10
def test_toxicity_learns_and_locates(spark, odd, none):
    rng = np.random.default_rng(12)
    texts, marks = [], []
    for i in range(400):
        said = [passage(rng, 8, 200) for _ in range(5)]
        toxic = i % 4 == 0
        if toxic:
            said[2] += " moronic"
        texts.append((i, ". ".join(said) + ".", "", "", 0, ""))
        marks.append((i, 1, int(toxic)))
    rows = toxicity.toxicity(spark.createDataFrame(texts, DOCS), labels(spark, marks)).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    hit = next(r for r in held if r.predicted)
    text = texts[hit.doc_id][1]
    assert any("moronic" in text[s.start:s.start + s.length] for s in hit.spans)
    scored = toxicity.toxicity(odd, labels(spark)).collect()
    assert len(scored) == len(ODD) and {r.score for r in scored} == {0.0}
    assert toxicity.toxicity(none, labels(spark)).count() == 0


def test_pipeline_stages(spark, sf):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < docs.count() < 200


def test_sql_twins_parse(sf):
    con = connect(sf)
    for sql in (chat_format.SQL, license_scan.sql()):
        con.execute(sql)
