"""Substring dedup, line dedup, n-gram join, packing and fingerprints against brute force and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hookline.llm import fingerprints, line_dedup, ngram_join, packing, substring_dedup
from hookline.llm.catalog_tables import vocabulary
from odd_rows import empty, odd  # noqa: F401  (fixtures)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made_texts(seed, n=60):
    """Short texts of few words with copied passages, near copies and repeated lines."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    passage = [rnd.choice(words) for _ in range(30)]
    out = []
    for k in range(n):
        t = [rnd.choice(words) for _ in range(rnd.randrange(0, 60))]
        if k % 3 == 0:
            at = rnd.randrange(len(t) + 1)
            t[at:at] = passage[rnd.randrange(10):rnd.randrange(15, 31)]
        if k % 5 == 4 and out:
            t = out[rnd.randrange(len(out))].replace("\n", " ").split()
            if len(t) > 3:
                t[rnd.randrange(len(t))] = "changed"
        out.append(rnd.choice([" ", "  ", "\t"]).join(t[:20]) + "\n" + " ".join(t[20:]))
    return [(k * 3 + 1, t) for k, t in enumerate(out)]


def brute_substring(rows, window=13):
    first, words = {}, {i: WORD.findall(t) for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for j in range(k, k + window)}
        out[i] = len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


@pytest.mark.parametrize("block", [1 << 20, 500])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    rows = made_texts(1)
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_substring(rows) and any(v[1] for v in got.values())


def test_covers_meet_at_every_shift():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_substring_dedup_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(odd).collect()}
    assert got == {(1, 3, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (None, 2, 0), (5, 30000, 0), (6, 4, 0)}
    assert substring_dedup.remove_repeats(empty).count() == 0




@pytest.mark.parametrize("group", [256, 1, 3])
def test_line_dedup_equals_brute_force(spark, monkeypatch, group):
    """All pairs, leaders of all groups, and both ways mixed."""
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", group)
    rows = made_texts(2, 40)
    got = {r.doc_id: r for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lines = [(i, k, x, frozenset(WORD.findall(x))) for i, t in sorted(rows) for k, x in enumerate(t.split("\n"))]
    for i, t in rows:
        mine = [(k, x, s) for j, k, x, s in lines if j == i]
        kept = [x for k, x, s in mine if not (s and any((j, m) < (i, k) and o and 5 * len(s & o) >= 4 * len(s | o) for j, m, _, o in lines))]
        assert got[i].text == "\n".join(kept) and got[i].n_lines == len(mine) and got[i].n_removed == len(mine) - len(kept)


@pytest.mark.parametrize("group", [256, 2])
def test_line_dedup_large_group_and_second_look(spark, monkeypatch, group):
    """Near copies of one line: those unlike the first one still find a later one."""
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", group)
    base = [f"t{k}" for k in range(20)]
    rows = [(k, " ".join(base[:20 - k % 5] + [f"x{k}{j}" for j in range(k % 5)])) for k in range(60)]
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: frozenset(t.split()) for k, t in rows}
    want = {k: int(any(5 * len(s & sets[j]) >= 4 * len(s | sets[j]) for j in range(k))) for k, s in sets.items()}
    assert got == want


def test_line_dedup_of_long_lines(spark, monkeypatch):
    """Lines long enough that the narrow parity map says nothing."""
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", 4)
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(600)]
    first = [rnd.sample(words, 300) for _ in range(4)]
    rows = []
    for k in range(40):
        own = list(first[k % 4])
        for _ in range(rnd.choice([0, 10, 28, 33, 34, 60, 100])):
            own[rnd.randrange(300)] = f"n{k}-{rnd.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: frozenset(t.split()) for k, t in rows}
    assert got == {k: int(any(5 * len(s & sets[j]) >= 4 * len(s | sets[j]) for j in range(k))) for k, s in sets.items()}


def test_line_dedup_sets_no_key_apart_and_loses_no_pair(spark, monkeypatch):
    """Rows of keys that many lines share go through no join of their own: a near copy group and common words, all keys in few bits."""
    monkeypatch.setattr(line_dedup, "SMALL_GROUP", 4)
    monkeypatch.setattr(line_dedup, "CROWD_BITS", 64, raising=False)
    frame = type(spark.range(1))
    kinds, join = [], frame.join
    monkeypatch.setattr(frame, "join", lambda self, other, on=None, how=None: (kinds.append((on, how)), join(self, other, on, how))[1])
    rnd = random.Random(9)
    base = [f"t{k}" for k in range(30)]
    rows = [(k, " ".join(rnd.sample(base, 29) + [f"x{k}"])) for k in range(40)] + [(100 + k, " ".join(rnd.choices("abcdefgh", k=rnd.randrange(3, 9)))) for k in range(60)]
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: frozenset(t.split()) for k, t in rows}
    assert got == {k: int(any(5 * len(s & sets[j]) >= 4 * len(s | sets[j]) for j in sets if j < k)) for k, s in sets.items()}
    assert not [on for on, _ in kinds if isinstance(on, str) and on == "tok"]


def test_line_dedup_of_lines_about_the_wide_map(spark):
    """A line just over the length that has a wide map finds one just under it."""
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words[:60])), (2, " ".join(words[:70])), (3, " ".join(words[:64] + words[100:103])), (4, " ".join(words[100:164])), (5, " ".join(words[100:180]))]
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0, 5: 1}


def test_line_dedup_compares_few_long_lines_that_are_not_alike(spark, monkeypatch):
    """Long lines that share most rare words, but too few of all, are told apart before their texts are read; blanks about words change nothing."""
    tried = []
    found = line_dedup.similar_lines
    monkeypatch.setattr(line_dedup, "similar_lines", lambda pairs, *rest: tried.append(pairs.count()) or found(pairs, *rest))
    rng = random.Random(4)
    shared = [f"rareword{k:03d}" for k in range(60)]
    rows = [(i, " ".join(shared + rng.sample([f"w{k:04d}" for k in range(2000)], 90))) for i in range(60)]
    rows += [(100, "  " + rows[7][1].replace(" ", "  ") + " "), (101, "\t".join(rows[9][1].split()) + " more")]
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, n in got.items() if n} == {100, 101}
    assert sum(tried) <= 60  # of 1,770 pairs with a common word


def test_line_dedup_hashes_the_words_of_no_copy(spark, monkeypatch):
    """Of equal lines only the first one's words are hashed."""
    tried = []
    found = line_dedup.prefixes
    monkeypatch.setattr(line_dedup, "prefixes", lambda lines, *rest: tried.append(lines.count()) or found(lines, *rest))
    rows = [(k, f"one line of all\nown{k} words{k} here{k}\nanother line they share") for k in range(60)]
    got = {r.doc_id: r.n_removed for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 2 * (k > 0) for k in range(60)}
    assert 62 <= sum(tried) <= 70  # of 180 lines


def test_line_dedup_leaves_the_session_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    assert line_dedup.deduplicate_lines(spark.createDataFrame([(1, "a b"), (2, "a b"), (2, "c d")], "doc_id long, text string")).count() == 3
    assert spark.conf.get(key, None) == before


def test_line_dedup_odd_rows(odd, empty):
    got = line_dedup.deduplicate_lines(odd).collect()
    assert len(got) == 8 and {(r.doc_id, r.n_removed) for r in got} == {(1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (None, 0)}  # the second of two equal rows holds copies
    assert next(r for r in got if r.doc_id == 2).text is None and next(r for r in got if r.doc_id == 4).text == " \n\t "
    assert line_dedup.deduplicate_lines(empty).count() == 0


def brute_near(rows, size=5):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t)
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    links, up = dict.fromkeys(sets, 0), {i: i for i in sets}
    find = lambda a: a if up[a] == a else find(up[a])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("block", [2048, 4])
def test_ngram_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", block)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", block)
    rnd = random.Random(5)
    base = [f"v{rnd.randrange(500)}" for _ in range(120)]
    rows = made_texts(3, 30)
    for k in range(25):  # a group of near copies
        w = list(base)
        for _ in range(k % 4):
            w[rnd.randrange(len(w))] = f"n{k}"
        rows.append((1000 + k, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows) and max(v[1] for v in got.values()) >= 10


def test_ngram_join_odd_rows(odd, empty):
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(odd).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (None, None, 0)}
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.keep_first(odd).count() == 7  # of the two equal rows one stays


def test_texts_of_repeated_ids_are_judged_on_their_own(spark):
    w, z = "one two three four five six seven", "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(0, w), (5, w), (5, z), (7, z + " a"), (9, "t"), (9, "t"), (9, None), (9, ""), (None, "t"), (None, "t"), (11, "alone and new")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, mark string, label int")
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_first(df).collect()), key=str)
    assert kept == sorted([(0, w), (5, z), (9, "t"), (None, "t"), (None, "t"), (11, "alone and new"), (9, None)], key=str) or kept == sorted(
        [(0, w), (5, z), (9, "t"), (None, "t"), (None, "t"), (11, "alone and new"), (9, "")], key=str)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(df.where("doc_id is not null")).collect()}
    assert got == {0: (0, 1), 5: (0, 2), 7: (5, 1), 9: (9, 0), 11: (11, 0)}


def test_lines_of_repeated_ids_are_judged_on_their_own(spark):
    rows = [(0, "p q r s"), (5, "p q r s"), (5, "totally other words here"), (9, "t u v"), (9, "t u v"), (None, "t u v"), (None, "t u v"), (3, None), (4, ""), (4, "\n"),
            (7, "a b c d e f g h i j\n\na b c d e f g h i k\nzz\ta\x0bb\tc"), (8, "zz a b c")]
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], "doc_id long, text string, mark string, gone int, row int, n_removed int")
    done = line_dedup.deduplicate_lines(df)
    assert done.columns == ["doc_id", "mark", "gone", "row", "text", "n_lines", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in done.collect()), key=str)
    assert got == sorted([(0, "p q r s", 1, 0), (5, "", 1, 1), (5, "totally other words here", 1, 0), (9, "t u v", 1, 0), (9, "", 1, 1), (None, "t u v", 1, 0), (None, "t u v", 1, 0),
                          (3, None, 0, 0), (4, "", 1, 0), (4, "\n", 2, 0), (7, "a b c d e f g h i j\n\nzz\ta\x0bb\tc", 4, 1), (8, "", 1, 1)], key=str)


def test_pruning_bound_keeps_similar_pairs():
    least = ngram_join.least_agreements(0.8, 1e-6)
    assert len(least) == ngram_join.VALUES // ngram_join.STEP and all(m < n * 0.8 for m, n in zip(least, range(16, 97, 16), strict=True))


def test_packing_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(vocabulary())
    rows = [(i, t) for i, t in made_texts(4)] + [(9001, None), (9002, "  Ünïcode, don't <|endoftext|> 12 &amp; " * 700), (9003, "one two " * 3000)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary()).toPandas()
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        mine = out[out.doc_id == i].sort_values("start")
        assert b"".join(mine.ids) == ids.tobytes() and (mine.doc_tokens == len(ids)).all()
        assert mine.start.tolist() == np.concatenate([[0], np.cumsum(mine.length)[:-1]]).tolist()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        n = s.length.sum()
        assert n <= 2048 and n & (n - 1) == 0 and s.offset.tolist() == np.concatenate([[0], np.cumsum(s.length)[:-1]]).tolist()
    pieces = packing.packed_pieces(odd, vocabulary()).collect()
    assert sum(r.length for r in pieces if r.doc_id in (2, 3, 4)) == 3 and {r.ids_crc32 for r in pieces if r.doc_id == 2} == {zlib.crc32(b"\1\0\0\0")}
    assert packing.packed_pieces(empty, vocabulary()).count() == 0


def test_sum_of_squares_choice():
    p = packing.Packer(8, 0)
    for n in (5, 5, 3):
        p.place((0, 0, np.zeros(n, np.uint32), n))
    assert p.levels[5] == 1  # the 3 filled one of the two windows at 5
    for trial in range(50):
        rnd = random.Random(trial)
        p.levels[1:8] = [rnd.randrange(4) for _ in range(7)]
        n = rnd.randrange(1, 8)
        best = min(((sum(x * x for x in after(p.levels, h, n)), -h), h) for h in range(0, 9 - n) if h == 0 or p.levels[h])[1]
        assert p.level_for(n) == best


def after(levels, h, n):
    x = levels[1:8].tolist()
    if h:
        x[h - 1] -= 1
    if h + n < 8:
        x[h + n - 1] += 1
    return x


@pytest.mark.parametrize("chars", [1 << 24, 300])
def test_edited_fingerprints(spark, odd, empty, monkeypatch, chars):
    monkeypatch.setattr(fingerprints, "BUCKET_CHARS", chars)
    rows = made_texts(6) + [(2, None), (5000, "é😀" * 11)]
    out = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + following[:cut]
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.fingerprint(t) and r.edited_fingerprint == fingerprints.fingerprint(edited)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert fingerprints.edited_fingerprints(odd).count() == 8 and fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(odd.where("doc_id = 6")).first()
    assert one.near_next == 1.0


def test_likeness_bounds():
    a, b = fingerprints.fingerprint("some text of a fair length, said once " * 9), fingerprints.fingerprint("0123456789" * 40)
    assert fingerprints.likeness(a, a) == 1.0 and fingerprints.likeness(a, b) == fingerprints.likeness(b, a) < 0.5
