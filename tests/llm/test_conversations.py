"""The conversation trie against brute force and SQL."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.llm import conversations

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append((turn is not None, turn or 0, tie, (role, text)))
    convs = {c: [x[-1] for x in sorted(v)] for c, v in convs.items()}
    members, end = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = tuple(convs.get(head, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        end[seq].append(c)
    children, own = defaultdict(list), {}
    for s, who in members.items():
        own[s] = (len(who) - 1) * (len(s[-1][1]) if s else 0)
        if s:
            children[s[:-1]].append(s)
    leaves, saved, out = {}, {}, []
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in children[s]) if children[s] else 1
        saved[s] = own[s] + sum(saved[k] for k in children[s])
        sha = hashlib.sha256(",".join(map(str, sorted(end[s]))).encode()).hexdigest()
        out.append((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), len(children[s]), leaves[s], saved[s], sha))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def crafted():
    rows = []
    for c in [*range(-3, 130), 200, 207, 1000, 5005, -250, -200]:
        for t in range((c * 7) % 9):
            rows.append((c, t, ["user", "assistant"][t % 2], ["hi", "héllo", f"t{t}", f"x{c % 4}", "🙂"][(c + t * (c % 3)) % 5]))
    rows += [(300, t, "user", f"long {t % 3}") for t in range(700)]  # one conversation over all tasks
    rows += [(301, t, "user", f"long {t % 3}") for t in range(650)]
    for c in range(400, 640):  # copies, a common opening
        rows += [(c, 0, "system", "same"), (c, 1, "user", "same again"), (c, 2, "user", f"{c % 40}")]
    rows += [(700, None, None, "null turn"), (700, 0, "a", None), (700, 0, "a", "tie"), (700, 0, "a", "tie"), (700, None, "", ""), (701, 5, None, None), (None, 0, "user", "nobody"), (700, 1, "ab", "c"), (702, 1, "a", "bc")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("hubs,chunk,piece", [(1000, 1024, 4096), (5, 7, 3)])
def test_equals_brute_force(spark, monkeypatch, hubs, chunk, piece):
    monkeypatch.setattr(conversations, "HUBS", hubs)
    df = spark.createDataFrame(crafted(), SCHEMA).repartition(3)
    for clash in ("depth", "hash", "pos", "path", "value", "h", "k", "last"):
        df = df.withColumn(clash, F.lit(1))
    assert result(conversations.trie(df, chunk=chunk, piece=piece)) == plain(crafted())


def test_sql_equals_brute_force(spark):
    con = duckdb.connect()
    rows = [r for r in crafted() if r[0] not in (300, 301)]
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({conversations.ORACLE_OP13})").fetchall()
    assert sorted(got, key=repr) == plain(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(conversations.op13_conversation_trie(spark, sf)) == plain(rows)


def test_empty_tables(spark):
    assert result(conversations.trie(spark.createDataFrame([], SCHEMA))) == []
    assert result(conversations.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []
    assert result(conversations.trie(spark.createDataFrame([(7, 0, "a", "b")], SCHEMA))) == plain([(7, 0, "a", "b")])
