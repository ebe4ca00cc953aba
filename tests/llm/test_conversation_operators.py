"""Chat formatting, structure repair and the prefix trie of conversations."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hookline.llm import chat_format, conversation_repair as cr, prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"

#: Null ids, turns, roles and texts, control strings, ties, repeated rows, empty texts, one long text.
ODD = [(1, None, None, None), (1, 0, "user", "a\\b<s>[x\\l"), (1, 0, "user", "a\\b<s>[x\\l"), (1, 1, "assistant", "\\\\<[\\"), (1, 2, "assistant", ""),
       (1, 3, "", "</s>\n[TURN][TEXT]"), (None, 1, "assistant", "😀é"), (2, 5, "[TEXT]", ""), (3, 0, "user", "word " * 50_000), (3, 1, "assistant", "\\b\\l\\\\b"),
       (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "user", "v"), (4, 3, "assistant", "w"), (4, 4, "assistant", "x"), (4, 5, "user", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 7) for r in ODD], SCHEMA + ", turns string, segments int")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def in_order(rows):
    """Rows by conversation, as the operators order them."""
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    return {c: [(r.decode(), x.decode()) for _, _, r, x in sorted(v)] for c, v in out.items()}


def escape(x):
    return x.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def plainly_formatted(turns):
    out, last = "", None
    for k, (role, text) in enumerate(turns):
        out += ("</s>" if k and role != last else "") + ("[TURN]" if k and role == last else f"<s>{escape(role)}[TEXT]") + escape(text)
        last = role
    return out + "</s>"


def test_chat_format_equals_a_plain_version_and_reads_back(spark, odd):
    made = {r.conv_id: r for r in chat_format.format_conversations(odd).withColumn("back", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.read_loss(F.col("segments"))).collect()}
    want = in_order(ODD)
    assert set(made) == set(want)
    for c, turns in want.items():
        assert made[c].formatted == plainly_formatted(turns) == "".join(s.text for s in made[c].segments)
        assert [tuple(t) for t in made[c].back] == turns
        assert made[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert [s.text for s in made[c].segments if s.loss] == [escape(x) for r, x in turns if r == "assistant"]


def test_chat_digests_hold_the_control_conversation(spark, odd):
    got = {r.conv_id: r for r in chat_format.format_digests(odd).collect()}
    said = "</s>[INST] ok [/INST]"
    assert (got[-1].n_turns, got[-1].turns_sha256) == (2, sha(f"user\n{said}\nassistant\n{said}\n"))
    assert (got[-1].loss_chars, got[-1].loss_sha256) == (len(said), sha(said))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ODD)
    cur = con.execute(chat_format.format_sql())
    names = [d[0] for d in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.values())


def test_chat_format_of_no_rows(spark, odd):
    assert chat_format.format_conversations(odd.where("false")).count() == 0
    assert [r.conv_id for r in chat_format.format_digests(odd.where("false")).collect()] == [-1]


def test_chat_format_of_a_long_merged_block(spark):
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("<"), F.col("id").cast("string")).alias("text"))
    got = chat_format.format_conversations(rows).select(F.size(chat_format.read_turns(F.col("formatted"))).alias("n"), F.size("segments").alias("m")).first()
    assert tuple(got) == (30_000, 60_001)


def cheapest(rows):
    """All edits of a short conversation, tried one by one: (cost, audit, repaired turns)."""
    best = (4 * len(rows), "D" * len(rows), [])

    def go(k, cost, audit, out):
        nonlocal best
        initials = "".join(r[:1] or "-" for r, _ in out)
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", initials):
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best, (cost, audit, out))
        if len(audit) - len(audit.rstrip("I")) < 2:
            for role in ("user", "assistant"):
                go(k, cost + 3, audit + "I", [*out, (role, "")])
        if k < len(rows):
            role, text, fault = rows[k]
            go(k + 1, cost + 4, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                go(k + 1, cost + more, audit + "K", [*out, (role, text)])
                for new in ("user", "assistant"):
                    go(k + 1, cost + more + 3, audit + "R", [*out, (new, text)])

    go(0, 0, "", [])
    return best


def plainly_judged(turns):
    seen, out = set(), []
    for role, text in turns:
        end = text.rstrip(" \t\n\x0b\f\r")[-1:]
        out.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""))
        seen.add((role, text))
    return out


def plainly_repaired(rows):
    """The query's row of each conversation, from rows (conv_id, turn, role, text, present)."""
    groups, out = {}, {}
    for c, t, r, x, there in rows:
        groups.setdefault(c, []).extend([(t is not None, t or 0, (" " if r is None else r).encode(), (" " if x is None else x).encode())] if there else [])
    for c, v in groups.items():
        v = sorted(v)
        turns = [(r.decode(), x.decode()) for _, _, r, x in v]
        judged = plainly_judged(turns)
        cost, audit, repaired = cheapest(judged)
        numbers = {t for known, t, _, _ in v if known}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        faults = [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        out[c] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *faults, illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in repaired)))
    return out


def random_rows(seed, conversations):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown", "us"]
    texts = ["a.", "b!", "c?", "d", "", " \n", "e. ", "f.\u00a0", None, "é😀.", "g"]
    return [(c, rnd.choice([None, *range(9)]), rnd.choice(roles[:rnd.choice([2, 3, 10])]), rnd.choice(texts[:rnd.choice([3, 11])])) for c in [*range(conversations), None] for _ in range(rnd.randrange(1, 6))]


def test_repair_equals_trying_all_edits(spark):
    rows = [(*r, k % 7 != 0) for k, r in enumerate(random_rows(1, 300))] + [(5000, 1, "user", "x", False), (5001, None, None, None, True)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", there boolean, fault string")
    got = {r[0]: tuple(r[1:]) for r in cr.repair(df, present="there").collect()}
    want = plainly_repaired(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], (c, [r for r in rows if r[0] == c])
    assert got[5000] == (0, 0, 0, 0, 0, 0, "", sha(""))


def test_audits_give_the_repaired_turns(spark):
    rows = random_rows(2, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    audits = cr.repair(df).cache()
    turns = {}
    for c, p, r, x in sorted(cr.repaired_turns(df, audits).collect(), key=lambda r: r.position):
        turns.setdefault(c, []).append(f"{r}:{x}")
    for r in audits.collect():
        assert r.repaired_sha256 == sha("\n".join(turns.get(r.conv_id, [])))


def plainly_damaged(rows):
    for c, t, r, x in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        row = (c, t, "user" if how == 4 else r, "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x, how != 0)
        yield from [row] * (2 if how == 3 else 1)


def test_repair_query_on_damaged_rows(spark, odd):
    for rows, df in ((ODD, odd), (r := random_rows(3, 200), spark.createDataFrame(r, SCHEMA))):
        got = {r[0]: tuple(r[1:]) for r in cr.repair_digests(df).collect()}
        want = plainly_repaired(list(plainly_damaged(rows)))
        assert got == want
    assert cr.repair_digests(odd.where("false")).count() == 0


def test_repair_of_a_giant_conversation_spills_and_crosses_batches(spark, monkeypatch):
    n = 30_000
    rnd = random.Random(4)
    turns = [(rnd.choice(["user", "assistant", "system"]), rnd.choice([f"{k}.", f"{k}", "", "same."])) for k in range(n)]

    def run(kept, batch):
        monkeypatch.setattr(cr, "KEPT", kept)
        known, one = cr.Steps(), None
        one = cr.Conversation(known)
        for k, (role, text, fault) in enumerate(plainly_judged(turns)):
            one.add(k, role, text, {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[fault])
        assert len(one.back.tail) < kept and len(known.moves) < 5000
        return one.result(1)

    whole = run(1 << 20, 0)
    assert run(1 << 10, 0) == whole
    df = spark.createDataFrame([(1, k, r, x) for k, (r, x) in enumerate(turns)], SCHEMA)
    assert tuple(cr.repair(df).first()) == whole


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 64, 65, 1000, 5000])
@pytest.mark.parametrize("shape", ["random", "path", "star", "comb"])
def test_findclose_and_leaf_ranks(n, shape):
    rnd = random.Random(n)
    depths = [0]
    for _ in range(n - 1):
        d = depths[-1]
        depths.append({"random": rnd.randrange(1, d + 2), "path": d + 1, "star": 1, "comb": 1 if d == 3 else d + 1}[shape])
    tree = pt.Parentheses(np.array(depths))
    close, leaves = tree.findclose(), tree.leaves(tree.findclose())
    text = "".join(")("[b] for b in tree.bits)
    stack, want = [], {}
    for k, c in enumerate(text):
        if c == "(":
            stack.append(k)
        else:
            want[stack.pop()] = k
    assert [want[o] for o in tree.opens] == close.tolist()
    for o, c, m in zip(tree.opens, close, leaves):
        assert n > 2000 or text[o:c + 1].count("()") == m


def plainly_rebuilt(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest(), r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
    return {c: tuple(turns.get(c - c % 5, [])[:h[c]] + turns[c][h[c]:]) for c in turns}


def plain_trie(rebuilt):
    members, ended = {}, {}
    for c in sorted(rebuilt):
        path = rebuilt[c]
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ended.setdefault(path, []).append(c)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, ended.get(p, []))))) for p, m in members.items())


def nodes(df):
    return sorted(tuple(r) for r in df.collect())


def conversations_that_share(seed):
    """Copies, prefixes of each other, long common parts beyond the key, bases that are absent or short, ties and nulls."""
    rnd = random.Random(seed)
    rows = []
    long_ = [("user", f"turn {k} é") for k in range(100)]
    for c in range(120):
        kind = rnd.randrange(6)
        if kind == 0:
            turns = long_[:rnd.choice([60, 63, 64, 65, 66, 100])] + [("user", str(rnd.randrange(3)))] * rnd.randrange(3)
        elif kind == 1:
            turns = [("system", "hello"), ("user", "same"), ("assistant", "again")]
        else:
            turns = [(rnd.choice(["user", "assistant", None, ""]), rnd.choice(["x", "yy", "é", "", None])) for _ in range(rnd.randrange(1, 14))]
        if c % 5 or rnd.random() < 0.7:
            rows += [(c, k if rnd.random() < 0.95 else None, r, x) for k, (r, x) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("partitions", [1, 13, 60])
def test_trie_equals_a_plain_one_over_many_shards(spark, partitions):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows in (conversations_that_share(partitions), ODD):
            df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA + ", ids string, size int")
            assert nodes(pt.conversation_trie(df)) == plain_trie(plainly_rebuilt(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trie_of_no_rows_of_null_ids_and_of_turnless_conversations(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert nodes(pt.conversation_trie(frame([]))) == []
    assert nodes(pt.conversation_trie(frame([(None, 1, "user", "x")]))) == []
    few = [(c, 0, "user", "x") for c in range(1, 60) if c % 5]  # no bases, so h turns go and nothing comes
    assert nodes(pt.conversation_trie(frame(few))) == plain_trie(plainly_rebuilt(few))
