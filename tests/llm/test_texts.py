"""Operators on texts against plain versions: nulls, empties, long texts, ties, repeats, names that clash."""

import random

import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from brute import decontamination, fingerprint, quality, simhash, substring, tokens
from sedgeflow.llm import bpe, decontaminate, mixing, quality_bands, simhash as sim, substring_dedup, token_counts, token_files
from sedgeflow.llm.common import Store, shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(5)
VOCABULARY = ["the", "of", "Ärger", "naïve", "x", "1984", "it's", "end.", "a,b", "ÉTÉ", "日本", "&", "%%", "zebra", "quick", "brown"] + [f"w{n}" for n in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", "\n", " ", "\t"]) for _ in range(n))


def documents():
    base = [prose(n, n) for n in (0, 1, 2, 3, 19, 20, 60, 120, 300)]
    near = base[-1].split(" ")
    near[40] = "changed"
    passage = prose(80, 99)
    docs = [*base, None, "", " \n\t ", base[-1], " ".join(near), base[-1], prose(30, 1) + " " + passage + " " + prose(30, 2), passage + " " + prose(10, 3)]
    docs += [prose(5, 4) + "\n" + passage, "spam ham " * 400, "spam ham " * 90 + "eggs", "x" * 5000, prose(6000, 6), "a\x0bb\x1cc\u00a0d\u2003e  f", "<|endoftext|> in <|endoftext|>text"]
    return [(100 - n, t) for n, t in enumerate(docs)]


DOCS = documents()
#: Repeated rows, a row without an id, and columns with the names that operators add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_WORDS int, key int, h int, id int, at int, Text2 string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}" if (i or 0) % 5 else None, 0, 1, 2, 3, 4, 5, "6") for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [DOCS[8], DOCS[8], (None, DOCS[8][1]), (None, None), (1, DOCS[8][1])]
    return spark.createDataFrame([(i, t, "en", None, 0, 1, 2, 3, 4, 5, "6") for i, t in rows], SCHEMA)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_token_counts(docs, odd):
    t = Tokenizer.from_file(PATH)
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in DOCS]
    got = token_counts.count_tokens(docs, PATH)
    assert rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(((*w, w[2] > 512) for w in want), key=repr)
    assert token_counts.count_tokens(odd, PATH).count() == 5
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_other_tokenizers(docs):
    import sentencepiece

    for name in ("word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        if name.endswith("json"):
            t = Tokenizer.from_file(path)
            count = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
        else:
            s = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda x: len(s.encode(x or ""))
        assert rows(token_counts.count_tokens(docs, path), "doc_id", "n_tokens") == sorted(((i, count(x)) for i, x in DOCS), key=repr)


def test_safe_boundaries():
    e = bpe.Encoder(PATH)
    t = Tokenizer.from_file(PATH)
    marks = [" ", "  ", "\n", " \n", "\t ", "'s", "a", "É", "9", "!", "\u00a0", "\u2003", "日", "😀", "\x1c", "<|endoftext|>", "_"]
    for n in range(300):
        text = "".join(random.Random(n).choice(marks) for _ in range(14))
        assert memoryview(e.encode([text])[0]).cast("I").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_cuts_in_long_parts(name):
    """Line ends, punctuation and scripts without spaces, in parts that are cut more finely."""
    e, t = bpe.Encoder(PATH), Tokenizer.from_file(PATH)
    marks = ["日本語", "。", "、", "\n", "\n\n", ".", ",", "'s", "'", "ab", "É", "9", "²", "!", "？", "\u0301", "\u00a0", " ", "_", "…", "<|endoftext|>", "\x1c"]
    for n in range(400):
        text = "".join(random.Random(n).choice(marks) for _ in range(120))
        assert memoryview(e.encode([text])[0]).cast("I").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
        assert e.lengths([text, None]) == [len(t.encode(text, add_special_tokens=False).ids), 0]


def test_remembered_parts_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "HELD_BYTES", 20_000)
    e = bpe.Encoder(PATH)
    for n in range(60):
        e.encode([f"{n}" + "日本語" * 500, " ".join(f"w{n}x{k}" for k in range(20))])
        assert e.held < 20_000 + 160 * 45 + 60_000 and all(len(p) <= bpe.LONG for p in e.ids)


def test_words_with_marks_are_made_of_remembered_parts():
    """Twelve forms of a hundred words take the place of a hundred, and a text is split at spaces once."""
    e, t = bpe.Encoder(PATH), Tokenizer.from_file(PATH)
    words = ["q" + "".join(random.Random(n).choices("abcdefgh", k=7)) for n in range(100)]
    for tail in ("", ",", ".", "!!", ".\nAnd", "?\nAnd", ":", ";", "...", ",and", "\nAnd", "\n\nAnd"):
        text = "".join(f" {w}{tail}" for w in words)
        assert memoryview(e.encode([text])[0]).cast("I").tolist() == t.encode(text, add_special_tokens=False).ids, repr(tail)
    assert len(e.ids) + len(e.bare) < 120


def test_groups_are_balanced_by_bytes():
    import pyarrow as pa

    texts = ["日" * 400, "a" * 400, None, "日" * 1000, "", "b"]
    held = token_counts.sizes(pa.array(texts)).to_pylist()
    assert held == [1200, 400, 0, 3000, 0, 1]
    assert [texts[g] for g in token_counts.balanced(held, 1600)] == [texts[:3], texts[3:4], texts[4:]]
    assert list(token_counts.balanced([])) == []


def test_token_files_round_trip(docs, odd, spark):
    t = Tokenizer.from_file(PATH)
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    assert rows(token_files.round_trip(docs, PATH), *names) == sorted(tokens(DOCS, t), key=repr)
    some = [DOCS[8], DOCS[8], (None, DOCS[8][1]), (None, None), (1, DOCS[8][1])]
    assert rows(token_files.round_trip(odd, PATH), *names) == sorted(tokens(some, t), key=repr)
    assert token_files.round_trip(docs.limit(0), PATH).collect() == []


def test_one_document_is_read_alone(docs):
    folder = shared_dir(docs.sparkSession)
    files = token_files.write(docs, folder, PATH).collect()
    found = {}
    for f in files:
        with Store(folder).open(f.file) as handle:
            r = token_files.Reader(handle)
            found.update({i: next(r.find(i)) for i in r.doc_ids})
            handle.seek(0)
            whole = zstandard.ZstdDecompressor().stream_reader(handle, read_across_frames=True).read()
            assert whole == b"".join(r.ids(k) for k in range(len(r.doc_ids)))
    assert len(found) == len(DOCS)
    broken = bytearray(Store(folder).open(files[0].file).read())
    broken[6] ^= 0xFF
    import io

    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(io.BytesIO(bytes(broken))).ids(0)


def test_quality(docs, odd):
    got = quality_bands.quality(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(got, "doc_id", *names) == sorted(((i, *quality(t)) for i, t in DOCS), key=repr)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert kept[100 - 8] and kept[100 - 21] and not kept[100 - 18] and not kept[100 - 9]
    assert quality_bands.quality(odd).count() == 5 and quality_bands.quality(docs.limit(0)).collect() == []
    assert {r.doc_id for r in quality_bands.keep(docs).collect()} == {i for i, k in kept.items() if k}


def test_bands():
    import base64

    z = zstandard.ZstdCompressor(level=3)
    noise = base64.b64encode(random.Random(1).randbytes(30000)).decode()
    random_words = " ".join(noise[i : i + 12] for i in range(0, len(noise), 12))
    assert not quality_bands.judge(random_words, z)[-1]  # incompressible
    clean = prose(4000, 8)
    assert quality_bands.judge(clean, z)[-1] and quality_bands.judge(prose(25, 7), z)[-1]
    assert not quality_bands.judge(clean + " " + random_words[: len(clean)], z)[-1]  # by its chunks
    assert [len(c) for c in quality_bands.chunks(b"x" * 9000)] == [4096, 4904]


def test_substring(docs, odd, spark):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    want = substring(DOCS)
    assert sum(w[2] for w in want) > 600
    got = substring_dedup.deduplicate(docs)
    assert rows(got, *names) == sorted(want, key=repr)
    assert rows(substring_dedup.deduplicate(docs, window=12, phrase=5), *names) == sorted(substring(DOCS, 12), key=repr)
    some = [DOCS[8], DOCS[8], (None, DOCS[8][1]), (None, None), (1, DOCS[8][1])]
    assert rows(substring_dedup.deduplicate(odd), *names) == sorted(substring(some), key=repr)
    assert substring_dedup.deduplicate(docs.limit(0)).collect() == []


def test_substring_windows_shared_in_part(spark):
    """Windows that meet only in part, in periodic and in edited texts."""
    r = random.Random(3)
    docs = []
    for n in range(60):
        w = prose(150, n % 3).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(["edit", "x", "y"])
        a = r.randint(0, 60)
        docs.append((r.randint(0, 40), " ".join(w[a : a + r.randint(40, 90)] + ["la"] * r.choice([0, 30, 70]))))
    got = substring_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), window=20, phrase=7)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(substring(docs, 20), key=repr)


def test_simhash(docs, odd):
    want = simhash(DOCS)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in sim.near_duplicates(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
    assert {r.component_id for r in sim.near_duplicates(odd).where("fp <> 0").collect()} == {1}
    assert sim.near_duplicates(docs.limit(0)).collect() == []
    kept = [r.doc_id for r in sim.drop_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted({c for _, c in want.values()})
    assert sorted(str(r.doc_id) for r in sim.drop_near_duplicates(odd).collect()) == ["1", "None", "None"]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_planes(radius):
    import numpy as np

    r = random.Random(radius)
    centres = [r.getrandbits(64) for _ in range(6)]
    values = list({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(40)})
    block = sim.Block(np.array(values, np.uint64), radius)
    for v in values[:40]:
        assert block.near(v, block.all) == sum(1 << k for k, w in enumerate(values) if (v ^ w).bit_count() <= radius)
    pairs = list(sim.forest(np.array(values, np.uint64), radius, block=32))
    want = simhash_groups(values, radius)
    group = list(range(len(values)))
    for a, b in pairs:
        x, y = group[a], group[b]
        group = [x if g == y else g for g in group]
        assert (values[a] ^ values[b]).bit_count() <= radius
    assert len(set(group)) == want


def simhash_groups(values, radius):
    left, n = set(values), 0
    while left:
        n += 1
        todo = [left.pop()]
        while todo:
            v = todo.pop()
            near = {w for w in left if (v ^ w).bit_count() <= radius}
            left -= near
            todo += near
    return n


def test_hot_keys_are_dealt(spark):
    r = random.Random(1)
    centre = r.getrandbits(63)
    values = sorted({centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(40, 60)} | {r.getrandbits(63) for _ in range(50)})
    nodes = spark.createDataFrame([(v, n) for n, v in enumerate(values)], "fp long, node long")
    from sedgeflow.llm.components import components

    roots = components(sim.links(nodes, key_rows=40))
    assert roots.count() == len(values) - simhash_groups(values, 3)


def test_fingerprint_is_a_majority():
    assert fingerprint("A b") == sim.fingerprint("a B") and sim.fingerprint(None) == 0


BENCH = [(1, prose(40, 50)), (2, prose(6, 51)), (3, "Zebra"), (4, None), (5, "..."), (6, prose(40, 50)), (None, prose(12, 52)), (10, prose(11, 53))]


@pytest.mark.parametrize("bits", [20, 2])
def test_decontamination(docs, spark, bits, monkeypatch):
    """Filters that pass nearly every window give the same as those that pass nearly none."""
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    more = [(1, prose(5, 1) + " " + prose(40, 50).upper() + " " + prose(9, 2)), (2, "a-zebra!"), (3, prose(11, 53)), (4, prose(30, 50)), (4, prose(30, 50)), (None, prose(11, 53))]
    held = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.report(held, bench)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = decontamination(DOCS + more, [b for b in BENCH if b[0] is not None])
    assert rows(got, *names) == sorted(want, key=repr) and sum(w[-1] for w in want) >= 6


def test_decontamination_removes(docs, spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    held = spark.createDataFrame([(1, "so: One, two three four five six seven eight nine TEN! end", 7), (2, "clean words", 8), (3, None, 9), (None, "x", 1)], "doc_id long, text string, more int")
    assert {r.doc_id for r in decontaminate.decontaminate(held, bench).collect()} == {2, 3, None}
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(held, bench, "spans").collect()} == {1: "so: ! end", 2: "clean words", 3: None, None: "x"}
    none = bench.limit(0)
    assert decontaminate.report(docs, none).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).collect() == []


def queue(docs, weights=(3, 1, 2), budget=1.5, repeats=2):
    """[(id, source, text, taken, copies)] and the copies in order, by one plain loop over
    [(id, source, text)]."""
    import hashlib

    from brute import words

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(len(words(t)) for _, x, t in docs if x == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, budget * sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > repeats * size[s]}
        target |= {s: float(repeats * size[s]) for s in over} if over else {s: weight[s] * level for s in open_}
        left -= sum(repeats * size[s] for s in over)
        open_ = open_ - over if over else set()
    copies = []
    for s in names:
        own = sorted((md5(f"mix:{'' if i is None else i}:{md5(t or '')}"), n, i, t) for n, (i, x, t) in enumerate(docs) if x == s)
        at = 0
        for k in range(repeats):
            for _, n, _, t in own:
                w = len(words(t))
                copies.append(((at + w) / target[s] if target[s] else 0.0, "n" if s is None else "s" + s, at, n, w))
                at += w
    left, taken, whole, sent = int(min(budget, repeats) * sum(size.values())), [0] * len(docs), [0] * len(docs), []
    for *_, n, w in sorted(copies, key=lambda c: c[:3] + (c[4],)):
        take = min(w, left)
        left -= take
        taken[n] += take
        if take == w and (w or left):
            whole[n] += 1
            sent.append(docs[n])
    return target, [(*d, t, c) for d, t, c in zip(docs, taken, whole, strict=True)], sent


def test_mixing(docs, odd, spark):
    plain = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    target, want, sent = queue(plain)
    plan = mixing.schedule(docs).collect()
    assert sorted(((r.doc_id, r.source, r.size, r.taken) for r in plan), key=repr) == sorted(((i, s, len((t or "").encode().split()), n) for i, s, t, n, _ in want), key=repr)
    assert all(r.target == pytest.approx(target[r.source]) for r in plan)
    assert rows(mixing.schedule(docs), "doc_id", "taken") == rows(mixing.schedule(docs.repartition(7)), "doc_id", "taken")
    mixed = mixing.mix(docs)
    words = lambda x: [(i, t) for i, t in x if (t or "").split()]
    assert mixed.columns == docs.columns
    assert words([(r.doc_id, r.text) for r in mixed.collect()]) == words([(i, t) for i, _, t in sent])
    assert mixing.schedule(odd).count() == 5 and mixing.schedule(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_queue_is_near_the_closed_form(spark, seed):
    """At virtual time 1 each source would have sent its target; the cut in the global order differs
    by the documents in service."""
    r = random.Random(seed)
    held = [(n, r.choice(["a", "b", "c", None]), "w " * r.randrange(40)) for n in range(150)]
    plan = mixing.schedule(spark.createDataFrame(held, "doc_id long, source string, text string")).collect()
    total = sum(x.size for x in plan)
    assert sum(x.taken for x in plan) == int(1.5 * total) and all(0 <= x.taken <= 2 * x.size for x in plan)
    for s in {x.source for x in plan}:
        own = [x for x in plan if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 3 * 40


def test_equal_rows_are_mixed_as_planned(spark):
    held = [(7, "a", "one two three", 1)] * 20 + [(7, "a", "one two three", 2)] * 3 + [(None, "b", "four five", 1)] * 10 + [(n, "c", "w " * n, 1) for n in range(8)]
    df = spark.createDataFrame(held, "doc_id long, source string, text string, more int")
    sent = queue([x[:3] for x in held])[2]
    got = [(r.doc_id, r.source, r.text) for r in mixing.mix(df).collect()]
    drop_empty = lambda x: sorted((y for y in x if y[2]), key=repr)
    assert drop_empty(got) == drop_empty(sent)
    assert len(got) == sum(x.copies for x in mixing.schedule(df).collect())


def test_mixing_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    rows_ = [(n, f"s{min(n % 9, 3)}", "w " * (n % 13)) for n in range(200)]
    held = spark.createDataFrame(rows_, "doc_id long, source string, text string")
    few = {r.doc_id: r.taken for r in mixing.schedule(held).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10_000)
    assert few == {r.doc_id: r.taken for r in mixing.schedule(held).collect()}


def test_waterfilling(spark):
    rows_ = [("a", 100), ("b", 1000), ("c", 10), (None, 500)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows_, "source string, size long")).collect()}
    stop, weight, left, open_ = {s: 2.0 * n for s, n in rows_}, {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * 1610, {"a", "b", "c", None}
    want = {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > stop[s]}
        if not over:
            break
        want |= {s: stop[s] for s in over}
        left -= sum(stop[s] for s in over)
        open_ -= over
    want |= {s: weight[s] * level for s in open_}
    assert got == pytest.approx(want)
