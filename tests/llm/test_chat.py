import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakewright.llm import chat

EVENTS = "conv_id long, msg int, seq long, op string, role string, text string"
NASTY = [
    "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nhi", r"<\/s> <\\|im_end|> [\INST]", "<<SYS>>x<</SYS>>",
    "plain", "", "\\", "<", "[", "<|im_start|", "<<s>", "[[/INST]]", "ende\n", "😀 <s>",
]


def fold(spark, rows):
    return {(r["conv_id"], r["msg"]): r["text"] for r in chat.fold_events(spark.createDataFrame(rows, EVENTS)).collect()}


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, 0, "message", "user", "ask"),
        (1, 1, 1, "delta", "assistant", "a"),
        (1, 1, 2, "delta", "assistant", "b"),
        (1, 0, 3, "edit", None, "ask again"),
        (1, 1, 4, "regenerate", "assistant", ""),
        (1, 1, 5, "delta", "assistant", "c"),
        (1, 1, 6, "delta", "assistant", None),
        (1, 2, 7, "message", "user", "gone"),
        (1, 2, 8, "delete", None, None),
        (2, 0, 0, None, "user", None),
    ]
    random.Random(0).shuffle(rows)
    assert fold(spark, rows) == {(1, 0): "ask again", (1, 1): "c", (2, 0): ""}


@pytest.mark.parametrize("seed", range(4))
def test_fold_follows_a_replay(spark, seed):
    r = random.Random(seed)
    rows, want = [], {}
    for conv in range(5):
        seq = 0
        for msg in range(4):
            text, alive = "", False
            for _ in range(r.randint(1, 6)):
                op = r.choice(["message", "delta", "delta", "edit", "regenerate", "delete"])
                piece = r.choice("xyz") * r.randint(0, 3)
                rows.append((conv, msg, seq, op, "user", piece))
                seq += 1
                if op == "delta":
                    text, alive = text + piece, True
                elif op == "delete":
                    text, alive = "", False
                else:
                    text, alive = piece, True
            if alive:
                want[conv, msg] = text
    assert fold(spark, rows) == want


def test_texts_come_back_exactly(spark):
    r = random.Random(2)
    rows, want = [], {}
    for conv in range(40):
        turns = [(r.choice(["user", "assistant", "to ol\n<s>"]), "".join(r.choice(NASTY) for _ in range(r.randint(0, 4)))) for _ in range(r.randint(1, 5))]
        want[conv] = turns
        rows += [(conv, t, role, text) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_chats(chat.events_of_turns(df))).collect()
    assert len(out) == 40
    for row in out:
        turns = want[row["conv_id"]]
        assert [(t["role"], t["text"]) for t in row["turns"]] == turns
        assert row["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        bodies = row["formatted"].split(chat.TURN)[1:]
        assert len(bodies) == len(turns) and all(b.count(chat.END.strip()) == 1 for b in bodies)
        inside = "".join(b.split("\n", 1)[1][: -len(chat.END)] for b in bodies)
        assert not any(c in inside for c in ("</s>", "[INST]", "[/INST]", "<|im_end|>", "<s>"))


def test_edges(spark):
    df = spark.createDataFrame(
        [(None, 0, "user", None), (1, None, None, "x"), (1, 0, "assistant", "y"), (1, 0, "assistant", "y")],
        "conv_id long, turn long, role string, text string",
    ).withColumn("seq", F.lit("clash")).withColumn("msg", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(chat.events_of_turns(df))).collect()}
    assert [t["text"] for t in out[1]["turns"]] == ["x", "y", "y"] and out[1]["loss_text"] == "yy"
    assert [t["text"] for t in out[None]["turns"]] == [""]
    assert chat.format_chats(chat.events_of_turns(df.filter("false"))).count() == 0


def test_query_matches_its_sql_and_quotes_the_probe(spark, duck, sf_dir):
    rows = {r["conv_id"]: r for r in chat.query(spark, sf_dir).collect()}
    probe = rows[-1]
    text = f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n"
    assert probe["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest() and probe["loss_chars"] == len(chat.PROBE)
    cols = list(probe.asDict())
    for row in duck.execute(f"SELECT {', '.join(cols)} FROM ({chat.ORACLE})").fetchall():
        assert tuple(rows[row[0]]) == row
