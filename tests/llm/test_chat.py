"""Chat formatting: exact round trips, masks and placeholders of typed parts."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import duckdb
import pytest

from tessera.llm import chat

SF = Path("/root/testdata/sf0.001")
KIND = f"conv_id long, turn long, role string, parts {chat.PARTS}"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def formatted(spark, rows, **options):
    c = chat.whole(chat.format_blocks(spark.createDataFrame(rows, KIND), **options))
    c = c.select("conv_id", "n_chars", "segments", "attachments", chat.text(c["segments"]).alias("text"), chat.masked(c["segments"]).alias("learned"))
    return {r.conv_id: r for r in c.withColumn("turns", chat.read_turns(c["text"])).collect()}


def test_parts_in_order(spark):
    rows = [
        (1, 0, "user", [part("text", "look "), part("image", ref="a.png", width=57, height=28), part("text", " and "), part("audio", ref="b.wav", seconds=2.5), part("image", ref="c.png")]),
        (1, 1, "assistant", [part("text", "I see "), part("document", ref="d.pdf", pages=3), part("text", "<image 1>")]),
    ]
    for block in (64, 1):  # one block, or one for each turn
        r = formatted(spark, rows, block=block)[1]
        assert r.text == "<s>[INST]user[/INST]look <image 1> and <audio 2><image 3></s><s>[INST]assistant[/INST]I see <document 4><\\image 1></s>"
        assert [tuple(a) for a in r.attachments] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 63), (3, "image", "c.png", 1), (4, "document", "d.pdf", 1536)]
        assert r.learned == "I see <image 1>" and r.n_chars == len(r.text)
        assert [tuple(t) for t in r.turns] == [("user", "look <image 1> and <audio 2><image 3>"), ("assistant", "I see <document 4><image 1>")]


def test_texts_come_back_whatever_they_hold(spark):
    rng = random.Random(3)
    atoms = ["<s>", "</s>", "[INST]", "[/INST]", "<image 1>", "<document 22>", "\\", "<", "[", "s>", "/s>", "a", "\n", "é", "$1", " "]
    texts = ["".join(rng.choices(atoms, k=rng.randrange(12))) for _ in range(400)] + ["\\" * 3000 + "</s>", "<" + "\\" * 3000 + "/s>", ""]
    rows = [(i % 7, i, rng.choice(["user", "assistant", "</s>[INST]", "system"]), [part("text", t)]) for i, t in enumerate(texts)]
    got = formatted(spark, rows)
    for c in range(7):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        assert [tuple(t) for t in got[c].turns] == [(r[2], r[3][0][1]) for r in own]
        assert got[c].learned == "".join(r[3][0][1] for r in own if r[2] == "assistant")
        assert got[c].n_chars == len(got[c].text) and got[c].text.count("</s>") == len(own)


def test_odd_messages(spark):
    rows = [
        (None, None, None, None), (None, 0, None, [None, part("text"), part("video", "kept as text")]), (2, 5, "user", []), (2, 5, "user", []),
        (2, 5, "assistant", [part("image"), part("text", "x")]), (2, 5, "assistant", [part("image"), part("text", "x")]), (3, -70, "user", [part("text", "first")]), (3, 2**40, "user", [part("text", "last")]),
    ]
    got = formatted(spark, rows)
    assert [tuple(t) for t in got[None].turns] == [("", ""), ("", "kept as text")]
    assert [tuple(t) for t in got[2].turns] == [("assistant", "<image 1>x"), ("assistant", "<image 2>x"), ("user", ""), ("user", "")]
    assert [t.text for t in got[3].turns] == ["first", "last"]
    assert formatted(spark, []) == {}


def test_long_conversation_is_in_many_blocks(spark):
    m = spark.range(5000).select(chat.F.lit(1).cast("long").alias("conv_id"), chat.F.col("id").alias("turn"), chat.F.lit("user").alias("role"), chat.F.lit("hi").alias("text"))
    b = chat.format_blocks(chat.from_texts(m))
    assert b.count() == -(-5000 // chat.BLOCK)
    assert chat.whole(b).first().n_chars == 5000 * len("<s>[INST]user[/INST]hi</s>")


@pytest.mark.skipif(not SF.exists(), reason="no driver tables here")
def test_query(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    columns = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    got = sorted(map(tuple, chat.op12_chat_formatting(spark, str(SF)).select(*columns.split(", ")).collect()))
    assert got == sorted(con.execute(f"select {columns} from ({chat.OP12_SQL}) q").fetchall())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert got[0][:5] == (-1, 2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said))
    rows = [(1, None, None, None, "x"), (1, 0, "assistant", "a</s>", "x"), (1, 0, "assistant", "a</s>", "x"), (None, 3, "user", None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts string").write.parquet(str(tmp_path / "conversations.parquet"))
    odd = {r.conv_id: r for r in chat.op12_chat_formatting(spark, str(tmp_path)).collect()}
    assert odd[1].n_turns == 3 and odd[1].turns_sha256 == sha("\n\n" + "assistant\na</s>\n" * 2) and odd[1].loss_sha256 == sha("a</s>" * 2) and odd[1].loss_chars == 10
    assert odd[None].turns_sha256 == sha("user\n\n") and odd[None].loss_sha256 == sha("")
