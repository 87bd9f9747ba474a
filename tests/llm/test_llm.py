"""The training-data operators against brute force, the tokenizers library and planted cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tripleloom.llm import bpe, ivfpq, katz, langid, packing, quality_rules, sharding, simhash, weak_quality
from tripleloom.llm.common import tokenizer_path

PLAIN = "the and of to in is was for that with on as by be this from he at are or".split()


def text(rng, n):
    return " ".join(rng.choice(PLAIN) + rng.choice(["", "", "ing", "ed", "tion"]) for _ in range(n))


def rows():
    """Nulls, empty and endless texts, copies, near copies, repeated rows, ties."""
    rng = random.Random(5)
    base = text(rng, 300)
    out = [
        (1, None), (2, ""), (3, " \n\t"), (4, base), (5, base), (6, base + " end"), (7, "x" * 30_000), (8, "one two"),
        (9, "one two"), (9, "one two"), (None, "no id at all"), (10, "Ünï <|endoftext|> a b  c\n\n d 's 12"),
        (11, " ".join(["again"] * 5000))
    ]
    return out + [(i, text(rng, rng.randint(1, 200))) for i in range(12, 80)]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(rows(), "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    return frame.withColumns({"n_tokens": F.lit("clash"), "kept": F.lit(1), "fp": F.lit(2), "block": F.lit(3), "_id": F.lit(4)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, words = Tokenizer.from_file(path), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    count, encode, own = bpe.counter(path), bpe.encoder(path), packing.WordTokenizer(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(1)
    parts = [
        "a", "the", "ing", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "é", "é", "Σ", "İ", "'s",
        "'", "!", "<|endoftext|>", "<|startoftext|>", "<|", "22", "½", "中文", "😀", "_", " "
    ]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(encode.text(s.encode()), "<u4").tolist() == ids
        assert count.text(s.encode()) == len(ids)
        assert bpe.decode(encode.v, encode.text(s.encode())).decode() == library.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(own.encode(s.encode(), 2), "<u4").tolist() == [*words.encode(s, add_special_tokens=False).ids, 2]


def test_word_pieces_go_to_the_model_and_rare_characters_to_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    ids = lambda s: np.frombuffer(own.encode(s.encode(), 2), "<u4").tolist()[:-1]
    marks = "\u0130\u035b\u031e'\u0130\u0349. a\u1ac0\u0f74Z y\u1c78\u1ac4\u0334 \u0594\u0d3c \u0e21\u0eba\u1df6"  # orders by Unicode's version
    for s in (marks, *("".join(map(chr, range(lo, lo + 64))) for lo in range(0x80, 0x3400, 64)), "".join(f" a{chr(c)}b" for c in range(0x80, 0x3400))):
        assert ids(s) == library.encode(s, add_special_tokens=False).ids
    plain = "Ciónradoas. don't AUX ÑOÑO!! été, ΑΣ Москва 中文 x1ü2 \x00\x7f ..."
    want = library.encode(plain, add_special_tokens=False).ids
    own = packing.WordTokenizer(path)
    own.of_text = None  # the library's whole chain takes four times as long as its model
    assert ids(plain) == want


def test_token_counts_and_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((i or -1, len(library.encode(t or "").ids)) for i, t in rows())
    assert sorted((r.doc_id or -1, r.n_tokens) for r in bpe.token_counts(docs, path).collect()) == want
    got = bpe.encode_decode_digests(docs, path).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == want
    digest = Counter((r.doc_id, r.decoded_sha256) for r in got)
    assert digest == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows())
    assert bpe.token_counts(empty, path).count() == bpe.encode_decode(empty, path).count() == 0


def test_packing(docs, empty):
    path = tokenizer_path("word_bpe_49k.json")
    own = packing.WordTokenizer(path)
    whole = Counter((i, zlib.crc32(own.encode((t or "").encode(), 2))) for i, t in rows())
    pieces = packing.pack_documents(docs, path).toPandas()
    used = defaultdict(list)
    for p in pieces.itertuples():
        used[p.sequence_id].append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
    for spans in used.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
        total = sum(n for _, n in spans)
        assert total <= 4096 and total & (total - 1) == 0  # no padding
    assert sum(pieces.length) == sum(len(own.encode((t or "").encode(), 2)) // 4 for _, t in rows())
    one = pieces[pieces.doc_id == 11].sort_values("start")
    assert (11, zlib.crc32(b"".join(one.ids))) in whole
    assert packing.pack_documents(empty, path).count() == 0


def test_texts_that_are_no_utf8(spark):
    """Each operator takes them as if replacement characters stood there."""
    bad = [(i, bytearray(x)) for i, x in enumerate([b"\xff\xfe", b"the \xc3( and \xe2\x82 of " * 30, b"ok " * 60 + b"\xf0\x9f\x98"])]
    broken = spark.createDataFrame(bad, "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text", "'aa' as lang")
    whole = spark.createDataFrame([(i, bytes(x).decode(errors="replace"), "aa") for i, x in bad], "doc_id long, text string, lang string")
    labels, path = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), tokenizer_path("byte_bpe_50k.json")
    for run in (
        lambda d: bpe.token_counts(d, path), lambda d: bpe.encode_decode_digests(d, path), lambda d: packing.packed_digests(
            d, tokenizer_path("word_bpe_49k.json")
        ),
        lambda d: quality_rules.assess(d, labels), lambda d: quality_rules.keep(d, labels).select("doc_id"), langid.identify, lambda d: langid.keep(
            d, gain=-99.0
        ).select("doc_id"),
        simhash.classes, lambda d: simhash.firsts(d).select("doc_id"), katz.score, weak_quality.classify,
    ):
        assert sorted(map(str, run(broken).collect())) == sorted(map(str, run(whole).collect()))


def test_pack_lengths_at_random():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.choice([1, 2, 63, 64, 65, 500, 4095, 4096, 4097, 20_000, rng.randint(1, 3000)]) for _ in range(rng.randint(0, 60))]
        seen = defaultdict(list)
        for size, window in packing.pack(lengths):
            assert sum(n for _, _, n in window) == size
            for d, s, n in window:
                seen[d].append((s, n))
        assert sorted(seen) == [i for i, n in enumerate(lengths) if n]
        for d, spans in seen.items():
            spans.sort()
            assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) == lengths[d]


def plain_fingerprint(t):
    w = (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps, most=4):
    label = list(range(len(fps)))
    for _ in fps:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= most) for i in range(len(fps))]
        if new == label:
            return label
        label = new
    return label


def test_simhash(docs, empty):
    got = simhash.classes(docs).collect()
    prints = [plain_fingerprint(t) for _, t in rows()]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for (i, _), f in zip(rows(), prints, strict=True))
    label = plain_components(prints)
    least = {x: min((i for (i, _), y in zip(rows(), label, strict=True) if y == x and i is not None), default=None) for x in label}
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least[x]) for (i, _), x in zip(rows(), label, strict=True))
    assert simhash.classes(empty).count() == 0
    kept = simhash.firsts(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(x for x in least.values() if x is not None) and None in ids


def test_first_of_each_class_by_row(spark):
    """Ids that come again with other texts, rows without an id, equal rows, columns named like a helper's."""
    rng = random.Random(21)
    a, b, c, d = (text(rng, 120) for _ in range(4))
    made = [(5, a, 1), (5, b, 2), (7, a, 3), (None, a, 4), (None, c, 5), (None, c, 6), (8, d, 9), (8, d, 8), (8, d, 8), (9, None, 0), (10, "", 0)]
    frame = spark.createDataFrame(made, "doc_id long, text string, _first int").withColumns(
        {"key": F.lit(1), "fp": F.lit("x"), "label": F.lit(None).cast("string")}
    )
    for parts in (1, 5):
        kept = simhash.firsts(frame.repartition(parts))
        assert kept.columns == frame.columns
        got = sorted(((r.doc_id, r.text, r._first) for r in kept.collect()), key=str)
        assert got == sorted([(5, a, 1), (5, b, 2), (None, c, 5), (8, d, 8), (9, None, 0)], key=str)
    assert simhash.firsts(frame.limit(0)).count() == 0


def test_tables_of_all_sizes(spark):
    """Whatever blocks come first, a table only reorders the bits, and all near pairs meet in one."""
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**64, 200, dtype=np.uint64)
    frame = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for n, many in ((10**6, 5), (10**9, 15), (10**11, 35)):
        tables = simhash.tables_for(n)
        assert len(tables) == many
        for t in tables[:: max(1, many // 4)]:
            assert (t.restored(t.permuted(fp)) == fp).all()
            got = {r.fp: (r.h, r.c) for r in frame.select("fp", t.bits_of(0, t.bits).alias("h"), t.bits_of(t.bits, t.bits + 8).alias("c")).collect()}
            for x, y in zip(fp.view(np.int64).tolist(), t.permuted(fp).tolist(), strict=True):
                assert got[x] == (y >> (64 - t.bits), y >> (56 - t.bits) & 255)
        for x in fp[:20]:
            y = int(x)
            for bit in rng.permutation(64)[:4]:
                y ^= 1 << int(bit)
            y = np.array([y], np.uint64)
            assert any(t.permuted(fp[fp == x])[:1] >> np.uint64(64 - t.bits) == t.permuted(y) >> np.uint64(64 - t.bits) for t in tables)


@pytest.mark.parametrize(("most_in_trie", "rows_in_task"), [(20_000, 1 << 20), (30, 1 << 20), (20_000, 100), (30, 500), (31, 500)])
def test_trie_join(spark, monkeypatch, most_in_trie, rows_in_task):
    monkeypatch.setattr(simhash, "ROWS_IN_TASK", rows_in_task)
    rng = np.random.default_rng(3)
    fps = set()
    for b in rng.integers(0, 2**64, 12, dtype=np.uint64):
        for _ in range(25):
            x = int(b)
            for _ in range(int(rng.integers(0, 6))):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    if most_in_trie == 31:  # tables of a much larger input
        monkeypatch.setattr(simhash, "tables_for", lambda n, most, m, of=simhash.tables_for: of(10**9, most))
    links = simhash.links(frame, most_in_trie=most_in_trie)
    found = {int(np.int64(r.node).view(np.uint64)): int(np.int64(r.label).view(np.uint64)) for r in simhash.components(links).collect()}
    want, got = defaultdict(set), defaultdict(set)
    for x, y in zip(fps, plain_components(fps), strict=True):
        want[y].add(x)
        got[found.get(x, x)].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(4, 1, 0), (12, 1, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.assess(docs, labels).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[11].n_repeat_words == 5000 and got[11].base_failed
    assert got[4].kept and not got[7].kept
    for raw in (b"a b c a b c d", b"a a a", b"a a a a", b"", b"a b c d e f a b c"):
        w = raw.split()
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert quality_rules.repeated_words(w) == len(covered)
    assert quality_rules.rules("é a#b\n\nx\nx\n x".encode()) == (5, 7, 1, 1, 0)
    assert quality_rules.assess(empty, labels).count() == 0
    assert quality_rules.assess(docs, labels.limit(0)).where("llr != 0").count() == 0
    keep = quality_rules.keep(docs, labels)
    assert keep.columns == docs.columns and Counter(r.doc_id for r in keep.collect()) == Counter(i for i, r in got.items() if r.kept)


def test_log_ratio_equals_plain_sums(spark):
    """llr and kept of every document against a loop over windows; texts that are no UTF-8; a tie with the threshold."""
    from tripleloom.llm.features import MULTIPLIERS

    def windows(raw):
        raw = raw.ljust(4) if raw else b""
        for k in range(len(raw) - 3):
            x = int.from_bytes(raw[k : k + 4], "little") * MULTIPLIERS[0] % 2**32
            x ^= x >> 15
            yield (x * MULTIPLIERS[1] % 2**32) >> 16

    rng = random.Random(17)
    made = [(i, text(rng, rng.randint(40, 90)).encode()) for i in range(60)]
    made += [(100 + i, " ".join(rng.choice(["zq#", "xx%", "&&"]) + str(rng.randint(0, 999)) for _ in range(60)).encode()) for i in range(10)]
    made += [(200, b""), (201, None), (202, b"ab"), (203, b"\xff\xfe broken \xc3 bytes " * 3 + text(rng, 60).encode()), (3, made[3][1])]
    given, made = made, [(i, t and t.decode(errors="replace").encode()) for i, t in made]
    good = {i for i in range(0, 40)} | {203}
    raw, trusted = Counter(), Counter()
    for i, t in made:
        n = Counter(windows(t or b""))
        raw.update(n)
        trusted.update(n if i in good else {})
    p_raw = lambda b: (raw[b] + 1) / (sum(raw.values()) + 2**16)
    ratio = {b: math.log((trusted[b] + 2**16 * p_raw(b)) / (sum(trusted.values()) + 2**16) / p_raw(b)) for b in raw}
    want = Counter()
    for i, t in made:
        n = Counter(windows(t or b""))
        llr = sum(ratio[b] * c for b, c in n.items()) / sum(n.values()) if n else 0.0
        want[(i, round(llr, 9))] += 1
    frame = spark.createDataFrame(
        [(i, None if t is None else bytearray(t)) for i, t in given], "doc_id long, text binary"
    ).selectExpr("doc_id", "cast(text as string) as text")
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(101, 0, 0), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.assess(frame, labels).collect()
    assert Counter((r.doc_id, round(r.llr, 9)) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD) for r in got)
    cut = sorted(r.llr for r in got if not r.base_failed)[7]
    assert {
        r.doc_id for r in quality_rules.assess(frame, labels, cut).where("kept").collect()
    } == {r.doc_id for r in got if not r.base_failed and r.llr >= cut}


def test_quality_and_weak_labels_on_held_out_junk(spark):
    rng = random.Random(8)
    good = [(i, text(rng, 600) + ".", 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "&&&" for w in text(rng, 600).split()), 0) for i in range(30)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_rules.assess(frame, labels).where("kept").collect()}
    assert kept == {i for i, _, _ in good}
    kept = {r.doc_id for r in weak_quality.classify(frame).where("kept").collect()}
    assert kept == {i for i, _, _ in good}


def test_weak_labels_are_of_whole_texts(spark, monkeypatch):
    """Junk outside the middle of a long text counts in its label and its buckets for the fit."""
    rng, seen = random.Random(9), []
    junk = lambda: " ".join(w + "&&&" for w in text(rng, 3000).split())
    made = [(i, f"{junk()}\n{text(rng, 6000)}.\n{junk()}" if i < 4 else text(rng, 200) + ".") for i in range(40)]
    whole = weak_quality.fit
    monkeypatch.setattr(weak_quality, "fit", lambda rows, labels: seen.append((rows, labels)) or whole(rows, labels))
    got = weak_quality.classify(spark.createDataFrame(made, "doc_id long, text string")).collect()
    (rows, labels), = seen
    assert sorted(labels) == pytest.approx(sorted(r.posterior for r in got))
    assert sorted(len(at) for at, _ in rows) == sorted(len(weak_quality.features(t.encode(), weak_quality.votes(t.encode()))[0]) for _, t in made)


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    n, k, good_share = 200_000, 5, 0.8
    right = np.array([[0.9, 0.7, 0.95, 0.6, 0.8], [0.97, 0.99, 0.9, 0.95, 0.85]])  # on bad, on good
    good = rng.random(n) < good_share
    correct = rng.random((n, k)) < right[good.astype(int)]
    vote = np.where(correct == good[:, None], 1, 0)
    vote[rng.random((n, k)) < [0.1, 0.3, 0.0, 0.5, 0.2]] = -1
    codes, counts = np.unique((vote + 1) @ 3 ** np.arange(k), return_counts=True)
    posterior, share, prior = weak_quality.expectation_maximisation(codes, counts, labellers=k, rounds=1000)
    assert abs(prior - good_share) < 0.01
    assert np.abs(share[0, :, 0] - right[0]).max() < 0.03 and np.abs(share[1, :, 1] - right[1]).max() < 0.03
    # the posterior is Bayes' rule with those accuracies
    p = [np.prod([1 if v < 0 else a if v == hit else 1 - a for v, a in zip(row, right[hit], strict=True)]) for row in vote[:50] for hit in (0, 1)]
    want = np.array([good_share * g / (good_share * g + (1 - good_share) * b) for b, g in zip(p[::2], p[1::2], strict=True)])
    assert np.abs(posterior[(vote[:50] + 1) @ 3 ** np.arange(k)] - want).max() < 0.05


def test_weak_labels_on_held_out_junk_of_other_kinds(spark):
    """Faults that no labeller names: signs of other kinds, shouting, one word over and over, lists of keys."""
    rng = random.Random(31)
    kinds = [
        lambda w: [x + rng.choice(["~~", "^^", "@@@", "=+="]) for x in w], lambda w: [x.upper() for x in w],
        lambda w: [w[0]] * len(w), lambda w: [y for x in w for y in (x, "/")]
    ]
    good = [(i, "\n".join(text(rng, rng.randint(20, 90)) + "." for _ in range(rng.randint(2, 6)))) for i in range(400)]
    bad = [(1000 + i, " ".join(kinds[i % 4](text(rng, 150).split()))) for i in range(80)]
    got = {r.doc_id: r.kept for r in weak_quality.classify(spark.createDataFrame(good + bad, "doc_id long, text string"), most_sample=200).collect()}
    assert sum(got[i] for i, _ in good) >= 396 and sum(got[i] for i, _ in bad) <= 8


def test_weak_label_sample_is_bounded(spark, monkeypatch):
    """A repeated id fills neither the driver nor the sample; the fit doesn't depend on the order of rows."""
    rng, seen = random.Random(9), []
    made = [(7, text(rng, 60)) for _ in range(30)] + [(8, "same text. " * 20)] * 200 + [(i, text(rng, 50)) for i in range(100, 140)]
    whole = weak_quality.fit
    monkeypatch.setattr(weak_quality, "fit", lambda rows, labels: seen.append(len(rows)) or whole(rows, labels))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    runs = [Counter((r.doc_id, round(r.score, 9)) for r in weak_quality.classify(frame.orderBy(F.rand(k)), most_sample=50).collect()) for k in (1, 2)]
    assert seen == [50, 50] and runs[0] == runs[1]


def test_weak_labels(docs, empty):
    got = weak_quality.classify(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows())
    assert not any(r.kept for r in got if r.doc_id in (1, 2, 3)) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert weak_quality.classify(empty).count() == 0


def test_language_id(spark, docs, empty):
    rng = random.Random(4)
    en, de = ["the", "thing", "with", "other"], ["der", "schön", "nicht", "über"]
    made = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(30)), "en" if i % 2 else "de") for i in range(200)]
    got = langid.identify(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()
    truth = {i: lang for i, _, lang in made}
    assert all(r.lang_pred == truth[r.doc_id] for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert found[1].lang_pred == found[2].lang_pred == "und" and found[1].score == 0 and 0 <= found[7].score <= 1
    assert langid.identify(empty).count() == 0
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0
    assert langid.keep(docs).columns == docs.columns


def test_language_id_equals_plain_naive_bayes(spark, monkeypatch):
    """Scores against a loop over n-grams; ties to the smaller name; more languages than a task holds."""
    monkeypatch.setattr(langid, "LANGS_IN_TASK", 2)
    rng = random.Random(14)
    alphabet = {"aa": "abcdé", "bb": "cdefΣ", "cc": "xyzàb", "dd": "pqr字s"}
    made = [
        (i, " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 25))), lang) for i,
        lang in enumerate(list(alphabet) * 30)
    ]
    made += [(900, None, "aa"), (901, "", "bb"), (902, "12 34", "cc"), (903, "a", None), (None, "xyz", "dd"), (904, "Σ", "bb")]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0

    def buckets(t):
        for n, mult in ((1, 1), (2, 2), (3, 3)):
            for k in range(len(t) - n + 1):
                x = ord(t[k]) * langid_multipliers[0] % 2**32
                for j in range(1, n):
                    x ^= x >> 13
                    x = (x + ord(t[k + j])) % 2**32 * langid_multipliers[j % 4] % 2**32
                x ^= x >> 15
                yield (x * langid_multipliers[mult % 4] % 2**32) >> 17

    from tripleloom.llm.features import MULTIPLIERS as langid_multipliers

    seen, counts = Counter(), defaultdict(Counter)
    for i, t, lang in made:
        if not held(i) and t is not None and lang is not None:
            seen[lang] += 1
            counts[lang].update(buckets(t.lower()))
    want = Counter()
    for i, t, _ in made:
        if not t or not any(c.isalpha() for c in t):
            want[(i, "und", 0.0)] += 1
            continue
        grams = Counter(buckets(t.lower()))
        joint = {}
        for lang in seen:
            total = sum(counts[lang].values()) + 0.5 * 2**15
            joint[lang] = math.log(seen[lang] / sum(seen.values())) + sum(n * math.log((counts[lang][b] + 0.5) / total) for b, n in grams.items())
        best = min(joint, key=lambda x: (-joint[x], x))
        want[(i, best, round(1 / sum(math.exp(v - joint[best]) for v in joint.values()), 6))] += 1
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string")
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.identify(frame).collect()) == want
    tied = spark.createDataFrame(
        [(i, "same words here", lang) for i in range(1, 40) for lang in ("yy", "xx")], "doc_id long, text string, lang string"
    )
    assert {(r.lang_pred, round(r.score, 9)) for r in langid.identify(tied).collect()} == {("xx", 0.5)}
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    with pytest.raises(ValueError, match="languages"):
        langid.identify(frame)


def test_language_stage_rejects_unlearned_languages(spark):
    import corpus_pipeline

    rng = random.Random(6)
    junk = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(60))
    made = [(i, text(rng, 80), "en") for i in range(200)]
    made += [
        (1000 + i, junk(letters), None) for i,
        letters in enumerate(["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрст", "αβγδεζηθικλμνξοπρσ", "的一是不了人我在有他这中大来上国"] * 10)
    ]
    kept = corpus_pipeline.language(spark, spark.createDataFrame(made, "doc_id long, text string, lang string"), "")
    assert {r.doc_id for r in kept.collect()} == set(range(200))


@pytest.mark.parametrize(
    ("split_bytes", "block_bytes", "fan"),
    [(katz.SPLIT_BYTES, katz.BLOCK_BYTES, katz.FAN), (3000, 4000, 1 << 20), (8000, 2000, 1)]
)
def test_katz(docs, empty, monkeypatch, split_bytes, block_bytes, fan):
    """One split; many splits and blocks of a task, with words split by pair; messages by two hops."""
    for name, value in (("SPLIT_BYTES", split_bytes), ("BLOCK_BYTES", block_bytes), ("FAN", fan)):
        monkeypatch.setattr(katz, name, value)
    got = katz.score(docs.coalesce(2)).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    seqs = [(i, [*katz.words((t or "").encode()), b"</s>"]) for i, t in rows()]
    uni, bi = Counter(), Counter()
    for i, w in seqs:
        if not held(i):
            uni.update(w)
            bi.update(zip([b"<s>", *w], w))
    total, types = sum(uni.values()), len(uni)

    def discount(counts):
        n = Counter(counts.values())
        return katz.Discount(np.array([n[r] for r in range(1, katz.K + 2)]))

    d1, d2 = discount(uni), discount(bi)
    cut = lambda c, d, absolute: c - d.absolute if absolute else c * (d.factor[c] if c <= katz.K else 1.0)
    p1 = {w: cut(c, d1, not d1.good) / total for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    context = defaultdict(dict)
    for (u, w), c in bi.items():
        context[u][w] = c
    model = {}
    for u, m in context.items():
        absolute = not d2.good or min(m.values()) > katz.K
        p = {w: cut(c, d2, absolute) / sum(m.values()) for w, c in m.items()}
        model[u] = p, (1 - sum(p.values())) / (1 - sum(p1[w] for w in m))
        assert abs(sum(p.values()) + model[u][1] * (unknown + sum(x for w, x in p1.items() if w not in m)) - 1) < 1e-9
    want = Counter()
    for i, w in seqs:
        s = 0.0
        for u, x in zip([b"<s>", *w], w):
            p, weight = model.get(u, ({}, 1.0))
            s += math.log10(p[x] if x in p else weight * p1.get(x, unknown))
        base = sum(math.log10((uni[x] + 0.1) / (total + 0.1 * (types + 1))) for x in w)
        want[(i, held(i), len(w), sum(uni[x] > 0 for x in w), total, round(base, 5), round(s, 5))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    assert all(r.gain_per_token == pytest.approx((r.score - r.base_score) / r.n_tokens) for r in got)
    assert katz.score(empty).count() == 0
    untrained = katz.score(docs.where("doc_id is null")).collect()
    assert untrained[0].train_tokens == 0 and untrained[0].score == 0


def test_sharding(docs, empty):
    for limit in (1 << 30, 4000, 300):
        got = sharding.assign(docs, limit).toPandas()
        assert len(got) == len(rows())
        for _, g in got.groupby(["shard", "page"]):
            assert g.n_bytes.sum() <= limit or len(g) == 1
        prefixes = sorted(set(got.shard))
        assert not any(b.startswith(a) for a in prefixes for b in prefixes if a != b)
    hot = docs.withColumn("doc_id", F.lit(1).cast("long"))
    got = sharding.assign(hot, 2000).toPandas()
    assert len(got) == len(rows()) and all(g.n_bytes.sum() <= 2000 or len(g) == 1 for _, g in got.groupby("page"))
    assert sharding.assign(empty).count() == 0


def test_written_shards_of_a_hot_key_fit(spark, tmp_path):
    made = [(i, "hot" if i % 3 == 0 else f"k{i}" if i % 7 else None, f"{i} " + "x" * 40) for i in range(600)]
    frame = spark.createDataFrame([(*made[0][:2], None), *made[1:]], "doc_id long, source string, text string")
    sharding.write_shards(frame, str(tmp_path / "out"), 1000, "source")
    got = spark.read.parquet(str(tmp_path / "out")).select("*", F.input_file_name().alias("f")).toPandas()
    assert Counter(got.doc_id) == Counter(range(600)) and got.set_index("doc_id").text.dropna().to_dict() == {i: t for i, _, t in made[1:]}
    size = defaultdict(int)
    for f, t in zip(got.f, got.text, strict=True):
        size[f.rsplit("/", 1)[0]] += len((t or "").encode())
    assert len(size) >= 20 and max(size.values()) <= 1000
    clash = frame.withColumns({"_SHARD": F.lit(1), "_page": F.lit("p"), "key": F.lit(2), "shard": F.lit(3), "_row": F.lit(4), "page": F.lit(5)})
    names = sharding.write_shards(clash, str(tmp_path / "clash"), 1 << 30, "source")
    assert names == ("__shard", "__page")
    got = spark.read.parquet(str(tmp_path / "clash"))
    assert got.columns == [*clash.columns, *names] and [tuple(r) for r in got.select(*names).distinct().collect()] == [("b", 0)]
    assert got.count() == 600 and got.where("_SHARD = 1 and _page = 'p' and key = 2 and shard = 3 and _row = 4 and page = 5").count() == 600


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    made = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000 + i, x[50].tolist()) for i in range(300)] + [
        (5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None] * 8), (5200, [1.0] * 3)
    ]
    frame = spark.createDataFrame(made, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    good = [(i, np.array(v, float)) for i, v in made if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, unit = np.array([i for i, _ in good]), np.stack([v / np.linalg.norm(v) for _, v in good])
    got = defaultdict(list)
    for r in ivfpq.search(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids if i % 50 == 0)
    hits = 0
    for q, near in got.items():
        s = unit @ unit[ids == q][0]
        order = [k for k in np.lexsort((ids, -np.round(s, 12))) if ids[k] != q][:5]
        hits += len({ids[k] for k in order} & {i for i, _ in near})
        assert len(near) == 5 and all(abs(score - s[ids == i][0]) < 1e-9 for i, score in near)
    assert hits >= 0.9 * 5 * len(got)
    assert [i for i, _ in got[50]] == [3000, 3001, 3002, 3003, 3004]
    assert ivfpq.search(frame.limit(0)).count() == 0


def test_written_tables_can_be_removed(spark, tmp_path):
    from tripleloom.llm.common import discard, shared_dir, table

    written, given = table(spark.range(10).toDF("x"), "gone"), f"{tmp_path}/given"
    spark.range(3).write.parquet(given)
    place = written.inputFiles()[0].split("://")[-1].rsplit("/", 1)[0]
    assert written.count() == 10 and shared_dir(spark).split("://")[-1].strip("/") in place
    discard(written)
    discard(spark.read.parquet(given))  # an input is no table of ours
    import os

    assert not os.path.exists(place) and spark.read.parquet(given).count() == 3


def test_equal_vectors_tie_exactly(spark):
    """Queries outside groups of equal vectors: the smaller ids come first, whatever the block, in every length."""
    rng = np.random.default_rng(11)
    made, ids = [], iter(np.random.default_rng(12).permutation(100_000).tolist())
    for g in range(40):
        x = rng.normal(size=24)
        copies = sorted(i for i in (next(ids) for _ in range(6 + g + g // 3)) if i % 50)
        made += [(i, x.tolist()) for i in copies]
        made += [(1_000_000 + 50 * g, (x + rng.normal(size=24) * 0.01).tolist())]
    made += [(2_000_000, [1.0, 2.0]), (2_000_001, [2.0, 1.0]), (2_000_050, [1.0, 1.0])]
    got = defaultdict(list)
    for r in ivfpq.search(spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(3)).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == sorted(i for i, _ in made if i % 50 == 0)
    assert {i for _, i, _ in got[2_000_000]} == {2_000_001, 2_000_050}
    for near in got.values():
        near.sort()
        assert [n for n, _, _ in near] == list(range(1, len(near) + 1))
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
    for g in range(40):
        at = [i for i, _ in made].index(1_000_000 + 50 * g)
        group = [i for i, x in made if x == made[at - 1][1]]
        near = got[1_000_000 + 50 * g]
        assert [i for _, i, _ in near] == sorted(group)[:5] and len({s for _, _, s in near}) == 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    base = text(rng, 200) + "."
    made = [(i, text(rng, 150) + ".", "en") for i in range(60)] + [
        (100, base, "en"), (101, base, "en"), (102, "short", "en"), (103, None, "en"),
        (104, " ".join(["12"] * 20 + ["13 14 15"] * 20), "en")
    ]
    docs = spark.createDataFrame(
        [(i, t, lang, "s", len(t or "")) for i, t, lang in made],
        "doc_id long, text string, lang string, source string, n_chars long"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(range(60)) | {100}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tokens = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t, _ in made if i in range(60) or i == 100}
    spans, used = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(tokens[p.doc_id]) and p.ids_crc32 == zlib.crc32(tokens[p.doc_id][p.start : p.start + p.length].tobytes())
        spans[p.doc_id].append((p.start, p.start + p.length))
        used[p.sequence_id].append((p.offset, p.offset + p.length))
    for of in (spans, used):  # each id in one piece, each sequence without a gap
        for ends in of.values():
            ends.sort()
            assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert all(spans[i][-1][1] == len(x) for i, x in tokens.items())
    assert all(ends[-1][1] <= 4096 and ends[-1][1] & (ends[-1][1] - 1) == 0 for ends in used.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
