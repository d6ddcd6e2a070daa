"""Brute force, round trips, recall and held-out accuracy of the operators."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, components, gif, html_text, licences, mixing, ngram_join, quality, sharding, toxicity

DIR = "/root/testdata/sf0.001"


# --- toxicity, quality --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = module.score(docs, module.train(docs, labels)).filter("held_out").join(labels, "doc_id").select("predicted", F.col(label).alias("y")).collect()
    tp, fp, fn = (sum(r.predicted == a and r.y == b for r in got) for a, b in ((1, 1), (1, 0), (0, 1)))
    assert 2 * tp / (2 * tp + fp + fn) >= least


def pair_rows(rng, n):
    rows, y = [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([1] * a + [2] * b + [int(x) for x in rng.choice(np.arange(10, 40), 3, replace=False)], np.int64))
        y.append(int(a and b))
    return rows, np.array(y)


@pytest.mark.parametrize("n", [800, 6000])
def test_machine_learns_a_pair(n):
    """Neither term alone is toxic, both together are; with the settings that the query uses."""
    m = toxicity.fit_machine(*pair_rows(np.random.default_rng(0), n))
    assert m.score(np.array([1, 2])) > 0.9 and 0.1 > max(m.score(np.array([1])), m.score(np.array([2])))


def test_pairs_in_texts_beat_the_weights_alone(spark):
    """Two words planted in whole documents of hundreds of others, toxic only together."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null").orderBy("doc_id").select("text").collect()]
    rng, terms, rows, y = np.random.default_rng(1), toxicity.Terms(), [], []
    for k in range(2000):
        a, b, words = rng.random() < 0.3, rng.random() < 0.3, texts[k % len(texts)].split(" ")
        for on, word in ((a, "grubbish"), (b, "martians")):
            if on:
                words.insert(int(rng.integers(0, len(words) + 1)), word)
        rows.append(np.sort(terms(" ".join(words))))
        y.append(int(a and b))
    y = np.array(y)

    def f1(m):
        p = np.array([m.score(t) >= toxicity.THRESHOLD for t in rows[1500:]])
        return 2 * (p & (y[1500:] == 1)).sum() / (p.sum() + y[1500:].sum())

    both, alone = (f1(toxicity.fit_machine(rows[:1500], y[:1500], factor_epochs=n)) for n in (30, 0))
    assert both >= 0.95 and both > alone + 0.05


def test_interactions_equal_brute_force():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, int(rng.integers(1, 20)), replace=False)) for _ in range(300)]
    r, v = rng.normal(size=300) + 3 * np.array([float(3 in x and 7 in x) for x in rows]), np.full(300, 0.2)
    among = np.arange(1, 40, 2)
    a, b, z = toxicity.interactions(rows, r, v, among, block=7)
    noise, want = np.sqrt(2 * np.log(len(among) ** 2 / 2)), {}
    for i in among:
        for j in among[among > i]:
            both = np.array([i in x and j in x for x in rows])
            s = r[both].sum() / np.sqrt(v[both].sum() + 0.25)
            if abs(s) > noise and both.sum() >= 5:
                want[i, j] = np.sign(s) * (abs(s) - noise)
    assert (3, 7) in want and {(i, j): pytest.approx(x, abs=1e-3) for i, j, x in zip(a.tolist(), b.tolist(), z.tolist(), strict=True)} == want


# --- quality ------------------------------------------------------------------------------------------------------------


def test_votes_equal_brute_force(spark):
    """Every score from all cosines, neighbour by neighbour; ties at the last place all vote."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    voters = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.score for r in quality.score(docs, voters).collect()}
    for i, text in list(texts.items())[:300]:
        cosines = sorted(zip((voters.latent([text])[0] @ voters.vectors.T).tolist(), voters.label.tolist(), strict=True), reverse=True)
        last = cosines[min(quality.NEIGHBOURS, len(cosines)) - 1][0]
        votes = [(max(c, 0.0) ** quality.SHARPNESS, y) for c, y in cosines if c >= last - 1e-6]
        total = sum(v for v, _ in votes)
        assert got[i] == pytest.approx(sum(v * y for v, y in votes) / total if total else voters.prior, abs=2e-3)


# --- sharding -----------------------------------------------------------------------------------------------------------


def best_capacity(sizes, k):
    best = {0: 0}
    for s in range(1, k + 1):
        new = {}
        for j in range(len(sizes) + 1):
            new[j] = min(max(best.get(i, 10**9), sum(sizes[i:j])) for i in range(j + 1) if i in best or i == j == 0)
        best = new
    return best[len(sizes)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12), st.integers(1, 5))
def test_minimax_is_optimal(sizes, k):
    a = np.array(sizes)
    want = best_capacity(sizes, k)
    assert sharding.smallest_capacity(a, k) == want
    ends = sharding.minimax_ends(a, k)
    assert len(ends) == k and ends[-1] == len(sizes) and ends == sorted(ends)
    assert max(sum(sizes[i:j]) for i, j in zip([0, *ends], ends, strict=False)) == want


def test_shards_are_the_optimum_over_groups(spark):
    rng = random.Random(5)
    texts = ["t" * rng.randint(0, 400) + str(i) for i in range(3000)] + ["same text" * 20] * 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(docs, 8).collect()
    groups = sharding.sized(docs).groupBy("_h").agg(F.sum("size").alias("s")).orderBy("_h").collect()
    want = sharding.smallest_capacity(np.array([g.s for g in groups]), 8)
    total = {}
    for r in rows:
        total[r.shard] = total.get(r.shard, 0) + r.size
    assert max(total.values()) == want and len(total) == 8
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(8) for i in range(sum(r.shard == s for r in rows))]
    assert len({r.shard for r in rows if r.doc_id >= 3000}) == 1


def test_a_huge_group_stands_alone(spark):
    texts = ["x" * 50 + str(i) for i in range(2000)] + ["huge" * 30] * 2000
    total = {}
    for r in sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect():
        total[r.shard] = total.get(r.shard, 0) + r.size
    assert len(total) == 8
    small = sorted(total.values())[:-1]
    assert max(small) < 1.05 * min(small)


# --- licences -----------------------------------------------------------------------------------------------------------


def test_templates_and_others():
    m = licences.train()
    for family, group in licences.TEMPLATES.items():
        for text in group:
            assert m.classify(text)[0] == family, text
    assert all(m.classify(o)[0] == licences.UNKNOWN for o in licences.OTHERS)
    assert [x[1] for x in m.scan("first line\nReleased under the MIT License.\nlast")] == ["mit"]


# --- bpe ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codecs():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    return bpe.Codec.of(path, public_tokenizers.PATTERN), own


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_the_library(codecs, text):
    ours, own = codecs
    ids = ours.encode(text)
    assert [int(i) for i in ids.split()] == own.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


def test_bpe_documents(spark, codecs):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=False)
    for r in out.join(docs.select("doc_id", "text"), "doc_id").collect():
        assert list(r.ids) == codecs[1].encode_ordinary(r.text) and bytes(r.decoded) == r.text.encode()


# --- gif ----------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 8), st.binary(max_size=5000), st.integers(1, 255))
def test_lzw_round_trip(bits, data, modulus):
    data = bytes(b % min(modulus, 1 << bits) for b in data)
    stream = gif.lzw_encode(data, bits)
    assert gif.lzw_decode(stream, bits, len(data)) == data
    assert gif.lzw_decode_all([stream, stream], [bits] * 2, [len(data)] * 2) == [data, data]


def test_full_table():
    data = np.random.default_rng(1).integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000))
def test_damaged_files_do_not_crash(data):
    good = gif.store(gif.payload_of("hello world " * 40)[0])
    cut = len(data) % len(good)
    for x in (good[:cut], b"GIF89a" + data, good[:cut] + data):
        try:
            list(gif.compose(gif.read(x)))
        except ValueError:
            pass


def test_disposal_transparency_and_local_palettes():
    red, blue = bytes([255, 0, 0, 0, 255, 0]), bytes([0, 0, 255, 9, 9, 9])
    frames = [
        gif.Frame(0, 0, 2, 2, bytes([0, 0, 0, 0]), red, delay=5),
        gif.Frame(0, 0, 2, 1, bytes([1, 0]), red, disposal=3, transparent=1),
        gif.Frame(1, 1, 1, 1, bytes([0]), blue, disposal=2),
        gif.Frame(0, 0, 1, 1, bytes([1]), red),
    ]
    back = gif.read(gif.write(gif.Gif(2, 2, frames=frames), red))
    assert [f.delay for f in back.frames] == [5, 0, 0, 0] and back.frames[2].palette[:3] == blue[:3]
    c = list(gif.compose(back))
    assert c[1][0, 0].tolist() == [255, 0, 0, 255]
    assert c[2][1, 1].tolist() == [0, 0, 255, 255] and c[2][0, 0].tolist() == [255, 0, 0, 255]
    assert c[3][1, 1].tolist() == [0, 0, 0, 0] and c[3][0, 0].tolist() == [0, 255, 0, 255]
    assert gif.histogram(c[3]).sum() == 3


def test_interlaced_rows():
    order = gif._rows(10)
    assert sorted(order) == list(range(10)) and order[:3] == [0, 8, 4]


def plain_lzw(data, bits):
    """A reader of code streams written from the format's description, code by code and bit by bit; shares nothing with the operator."""
    pos, width, table, last, out = 0, bits + 1, None, None, bytearray()
    while pos + width <= 8 * len(data):
        code = sum((data[(pos + i) // 8] >> (pos + i) % 8 & 1) << i for i in range(width))
        pos += width
        if code == 1 << bits:
            table, width, last = [bytes([i]) for i in range(1 << bits)] + [b"", b""], bits + 1, None
        elif code == (1 << bits) + 1:
            break
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return bytes(out)


def plain_gif(data):
    """(palette, [(delay, samples)]) of a file without interlace, extensions other than graphic control, or local palettes."""
    size = 3 << (data[10] & 7) + 1
    palette, at, frames, delay = data[13 : 13 + size], 13 + size, [], 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            delay = data[at + 4] | data[at + 5] << 8
            at += 8
            continue
        w, h = data[at + 5] | data[at + 6] << 8, data[at + 7] | data[at + 8] << 8
        bits, at, stream = data[at + 10], at + 11, b""
        while n := data[at]:
            stream, at = stream + data[at + 1 : at + 1 + n], at + 1 + n
        at += 1
        frames.append((delay, plain_lzw(stream, bits)[: w * h]))
    return palette, frames


@pytest.mark.parametrize("text", ["", None, "short", "ü" * 288, "aab" * 3000, "".join(chr(33 + i * i % 900) for i in range(5000))])
def test_columns_from_an_independent_reader(text):
    raw = (text or "").encode()
    payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
    media = gif.store(payload)
    palette, frames = plain_gif(media)
    back = b"".join(f[1] for f in frames)
    assert back == payload and all(palette[3 * i : 3 * i + 3] == bytes([i] * 3) for i in range(256))
    seen = {}
    for b in back:
        seen[(b >> 6) * 21] = seen.get((b >> 6) * 21, 0) + 1
    feature = f"{len(frames)};{sum(f[0] for f in frames)};" + ",".join(f"{k}:{seen[k]}" for k in sorted(seen))
    assert gif.digest(text) == (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)


def test_decode_column(spark):
    media = gif.store(gif.payload_of("text" * 300)[0])
    claims = b"GIF89a" + b"\xff\xff\xff\xff" + b"\0\0\0" + b"\x2c\0\0\0\0\xff\xff\xff\xff\0" + b"\x02\x02\x44\x01\0\x3b"
    frame = media[:6] + b"\x18\0\x18\0" + media[10:13] + media[13:781] + b"\x2c\0\0\0\0\xff\xff\xff\xff\0" + b"\x02\x02\x44\x01\0\x3b"
    rows = [(1, media), (1, media), (2, b"no gif"), (3, None), (4, media[:1000]), (5, claims), (6, frame), (7, b""), (None, media)]
    df = spark.createDataFrame(rows, "id long, media binary").select("*", *[F.lit("clash").alias(c) for c in ("frame", "delay", "rgba", "width", "i", "of")])
    got = gif.decode_column(df).collect()
    whole = [r for r in got if r.id == 1]
    assert sorted(r.frame for r in whole) == [0, 0, 1, 1, 2, 2] and {r.delay for r in whole} == {gif.DELAY}
    assert all((r.width, r.height, len(r.rgba), sum(r.histogram)) == (24, 24, 4 * 576, 576) for r in whole)
    first = next(r for r in whole if r.frame == 0).rgba
    assert bytes(first[0::4]) == (b"text" * 300)[:576]
    assert [(r.frame, r.rgba) for r in got if r.id in (2, 3, 5, 6, 7)] == [(None, None)] * 5
    assert len([r for r in got if r.id is None]) == 3 and 1 <= len([r for r in got if r.id == 4]) <= 3
    assert gif.decode_column(df.filter("false")).count() == 0


# --- jaccard join -------------------------------------------------------------------------------------------------------


def ship(monkeypatch, values):
    """Set constants of the join in the driver and, as functions carry the module by name, in the workers."""
    for k, v in values.items():
        monkeypatch.setattr(ngram_join, k, v)
    if values:
        run = DataFrame.mapInArrow

        def patched(self, func, schema, *args, **kw):
            def with_values(batches):
                from quarry.llm import ngram_join as there

                for k, v in values.items():
                    setattr(there, k, v)
                try:
                    yield from func(batches)
                finally:
                    for k in values:
                        setattr(there, k, before[k])

            return run(self, with_values, schema, *args, **kw)

        before = dict(ORIGINAL)
        monkeypatch.setattr(DataFrame, "mapInArrow", patched)


ORIGINAL = {k: getattr(ngram_join, k) for k in ("NODE_BITS", "SPLIT", "PARTS", "COUNTERS", "HUBS", "MORE_HUBS", "BROADCAST_ROWS", "CACHE")}


def varied(rng, n):
    rows = []
    for _ in range(n):
        base = [str(rng.randrange(5000)) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = "edit"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "num", "forced"), [(3, 90, {}), (5, 80, {}), (2, 60, {}), (3, 90, {"NODE_BITS": 5}), (5, 80, {"SPLIT": 1, "PARTS": 3, "COUNTERS": 64, "HUBS": 2, "MORE_HUBS": 2, "BROADCAST_ROWS": 0, "CACHE": 50})])
def test_join_equals_brute_force(spark, monkeypatch, n, num, forced):
    """Also where classes clash in the bits of their nodes, and where most segments are split and joined by shuffles."""
    ship(monkeypatch, forced)
    rows = varied(random.Random(num), 250)
    shared = " ".join(str(i) for i in range(9000, 9060))
    rows += [(10_000 + i, f"{shared} {i} {i + 1} {i + 2} {i % 3}") for i in range(60)]
    sets = {i: ngram_join.shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.sampled_from([60, 80, 90]), st.integers(0, 10**6))
def test_linked_sets_share_a_probed_signature(size, changed, num, seed):
    """The pigeonhole: whatever linked sets look like, one of them probes a signature that the other one enters."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, size, dtype=np.uint64)
    changed = min(changed, size)
    y = np.unique(np.r_[x[changed:], rng.integers(0, 2**63, int(rng.integers(0, changed + 1)), dtype=np.uint64)])
    x = np.unique(x)
    common = len(np.intersect1d(x, y))
    if not common or 100 * common < num * (len(x) + len(y) - common) or np.array_equal(x, y):
        return
    (sx, px), (sy, py) = ngram_join.signatures(x, num, 100), ngram_join.signatures(y, num, 100)
    hit = set(sx.tolist()) & set(sy.tolist())
    assert hit
    # a set may leave out ``spare`` entries of a scheme: so many shared ones must be there that one is left, on one side at least
    left = lambda s, p: any(sum(v in hit and q == spare for v, q in zip(s.tolist(), p.tolist(), strict=True)) > spare for spare in set(p.tolist()))
    assert left(sx, px) or left(sy, py)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_rows_come_near_the_target(spark):
    """A third of the rows are one row, in one source; the mix takes some of them once more and not all or none."""
    rows = [(7, "a b c d e f g h i j", "x")] * 1000 + [(i, "w " * (i % 30 + 1), "y") for i in range(500)] + [(i, "z " * (i % 7), None) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {}
    for r in mixing.mix(df).collect():
        t = want.setdefault(r.source_size, [r.target, 0])
        t[1] += r.taken
    assert len(want) == 3 and all(abs(t - n) <= 30 for t, n in want.values())
    again = mixing.mixed(df).groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()
    assert sorted(r.n for r in again) == sorted(n for _, n in want.values())


# --- mixing -------------------------------------------------------------------------------------------------------------


def iterated(sizes, weights, cap):
    """Water-filling as its definition says: hand out by weight, cut, hand out the rest."""
    target, left, open_ = {}, float(sum(sizes.values())), dict(weights)
    while open_:
        total = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * w / total for s, w in open_.items()}
        for s in over:
            target[s] = cap * sizes[s]
            del open_[s]
        left = sum(sizes.values()) - sum(target.values())
    return target


def test_water_fill(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = {f"s{i:02}": rng.choice([1, 5, 40, 300, 5000]) for i in range(9)}
        got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = iterated(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}, 3)
        assert got == pytest.approx(want)
        assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_comes_near_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert all(r.taken <= 3 * r.size for r in rows)
    per = {}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        t = per.setdefault(source[r.doc_id], [r.target, 0, 0])
        t[1] += r.taken
        t[2] = max(t[2], r.size)
    assert all(abs(t[0] - t[1]) <= t[2] for t in per.values())


# --- html ---------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><nav><ul><li><a href=/a>Home</a></li><li><a>About</a></li></ul></nav></header>
<div class='cookie-notice'><p>We use cookies to improve your experience on this site. Accept?</p></div><main><article><header><h1>Title &amp; more</h1></header>
<p>First <b>bold</b>text.<br>Next &nbsp; line</p><div class='ad'><p>Buy now the best thing ever made.</p></div><ul><li>one item</li><li>two items</li></ul>
<script>var x = "</p>";</script><section id='comments'><article class='comment'><p>I think this is a long comment with words.</p></article></section></article></main>
<aside class='sidebar'><p>Some related text here.</p></aside><form><label>Name</label></form><footer><p>&copy; 2024 All rights reserved.</p></footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst boldtext. Next line\n\none item\n\ntwo items"


@settings(max_examples=80, deadline=None)
@given(st.text("<>/\"'= pdivaul!-&;x", max_size=120))
def test_broken_html(html):
    assert isinstance(html_text.main_text(html), str)


def test_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randint(1, 7)
        source, sink = [rng.random() for _ in range(n)], [rng.random() for _ in range(n)]
        pairs = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]
        flow = html_text.Flow(n + 2)
        for i in range(n):
            flow.edge(n, i, source[i])
            flow.edge(i, n + 1, sink[i])
        for i, j, w in pairs:
            flow.edge(i, j, w, w)
        cost = lambda keep: sum(sink[i] if keep[i] else source[i] for i in range(n)) + sum(w for i, j, w in pairs if keep[i] != keep[j])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(flow.source_side(n, n + 1)[:n]) == pytest.approx(best)


# --- nearest neighbours -------------------------------------------------------------------------------------------------


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET", 20)  # so that buckets are split
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect() + [(10_000 + i, [1.0] * 64) for i in range(40)]
    df = spark.createDataFrame([(r[0], [float(x) for x in r[1]]) for r in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids, m = np.array([r[0] for r in rows]), np.array([list(r[1]) for r in rows], np.float64)
    norm, hits, n = np.linalg.norm(m, axis=1), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = m @ m[q] / (norm * norm[q])
        s[ids == ids[q]] = -9
        best = set(ids[np.lexsort((ids, -np.round(s, 12)))[:5]])
        hits, n = hits + len(best & {v for v, _ in got[ids[q]].values()}), n + 5
        assert sorted(got[ids[q]]) == [1, 2, 3, 4, 5]
        for v, score in got[ids[q]].values():
            assert score == pytest.approx(s[np.flatnonzero(ids == v)[0]], abs=1e-12)
    assert hits / n >= 0.9


def test_held_out_rule(spark):
    from quarry.llm.common import held_out

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


# --- brute force of scores, cuts and stages -----------------------------------------------------------------------------


def test_machine_sum_is_weights_and_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.fit_machine(*pair_rows(rng, 800))
    for ids in ([1, 2, 11, 12], [1], [], [2, 30, 35], [1, 2]):
        at = [int(m.place[i]) for i in ids if m.place[i]]
        plain = m.bias + sum(float(m.weight[i]) for i in at) + sum(float(m.factor[i] @ m.factor[j]) for k, i in enumerate(at) for j in at[k + 1 :])
        assert m.sum(np.array(ids, np.int64)) == pytest.approx(plain, abs=1e-3)
        assert m.score(np.array(ids, np.int64)) == pytest.approx(1 / (1 + np.exp(-(m.scale * plain + m.shift))), abs=1e-3)


def test_scores_of_the_query_are_those_of_the_texts(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    terms = toxicity.Terms()
    for r in toxicity.score(docs, machine).collect():
        words = {w.strip(toxicity.STRIP) for w in (texts[r.doc_id] or "").lower().split()} - {""}
        plain = {f"w{w}" for w in words} | {f"b{n}{w[:n]}" for w in words for n in (4, 5, 6) if len(w) >= n}
        ids = {xxhash.xxh64_intdigest(t.encode()) % toxicity.SPACE for t in plain}
        assert set(terms(texts[r.doc_id]).tolist()) == ids
        assert r.score == pytest.approx(machine.score(np.array(sorted(ids), np.int64)), abs=1e-6) and r.predicted == int(r.score >= 0.3)


def test_labelling_of_pages_is_the_cheapest():
    """The cut of whole pages against every labelling, with the costs computed anew."""
    w, tried = np.array(html_text.weights()), 0
    for page in [*html_text.training_pages(60, seed=7), PAGE]:
        blocks = html_text.blocks_of(page)
        if not 1 < len(blocks) <= 11:
            continue
        z = np.clip(np.array([html_text.features(b) for b in blocks]) @ w, -20, 20)
        edges = [(i - 1, i, html_text.SEQUENCE) for i in range(1, len(blocks))]
        for i, b in enumerate(blocks):
            for up, share in ((b.node.parent, 1.0), (b.node.parent.parent if b.node.parent else None, 0.5)):
                near = [j for j in range(i) if up is not None and any(n is up for n in (blocks[j].node.parent, blocks[j].node.parent.parent if blocks[j].node.parent else None))]
                if near and near[-1] != i - 1:
                    edges.append((near[-1], i, html_text.PROXIMITY * share))

        def cost(keep):
            own = sum(np.log1p(np.exp(-z[i])) if k else np.log1p(np.exp(z[i])) for i, k in enumerate(keep))  # noqa: B023
            return own + sum(c for i, j, c in edges if keep[i] != keep[j])  # noqa: B023

        best = min(cost([bool(m >> i & 1) for i in range(len(blocks))]) for m in range(1 << len(blocks)))
        assert cost(html_text.label(blocks, tuple(w))) == pytest.approx(best)
        tried += 1
    assert tried >= 5
