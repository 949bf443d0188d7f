"""Folding against a plain fold, rendering read back, and the query on awkward conversations against plain Python."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cipherlode.llm import chat

LOG = "conv_id long, turn long, message long, seq long, kind string, role string, text string, at long, n long, extra string"


def plain_fold(events):
    """Messages by place, one event after another; a regeneration drops what comes later."""
    seen, said = set(), {}
    for conv, turn, message, seq, kind, role, text, at, n in sorted(events, key=lambda e: tuple((x is not None, x) for x in (e[0], e[3], e[4], e[6], e[7], e[8]))):
        if (conv, turn, message, seq) in seen:
            continue
        seen.add((conv, turn, message, seq))
        key, text = (conv, turn, message), text or ""
        old_role, old = said.get(key, ["", ""])
        if kind == "regenerate":
            for k in [k for k in said if k[0] == conv and k[1:] > (turn, message)]:
                del said[k]
        if kind in ("open", "regenerate"):
            said[key] = [old_role if role is None else role, ""]
        elif kind == "delta":
            said[key] = [old_role, old + text]
        elif kind == "edit":
            said[key] = [old_role, text if at is None else old[: max(at, 0)] + text + old[max(at, 0) + max(n or 0, 0) :]]
        elif kind == "remove":
            said.pop(key, None)
    return sorted((*k, *v) for k, v in said.items())


def random_log(seed, size):
    r = random.Random(seed)
    log = []
    for seq in range(size):
        kind = r.choice(["delta"] * 6 + ["open", "edit", "regenerate", "remove", "open"])
        log.append((r.choice([1, 2, 2, 2]), r.randint(0, 5), r.randint(0, 1), seq, kind, r.choice(["user", "assistant", "x"]) if kind in ("open", "regenerate") else None, r.choice(["", "ab", "é😀", None, "word "]), r.choice([None, 0, 1, 3, 99, -2]), r.choice([None, 0, 2, -1])))
    return log


def test_fold_against_plain(spark):
    """Roles of messages that were voided or removed aren't compared: the fold keeps the last one that it saw."""
    for seed in range(6):
        log = random_log(seed, 150)
        shuffled = log + log[::3]
        random.Random(seed).shuffle(shuffled)
        got = chat.fold(spark.createDataFrame([(*e, "x") for e in shuffled], LOG)).collect()
        assert sorted((r.conv_id, r.turn, r.message, r.text) for r in got) == [(a, b, c, t) for a, b, c, _, t in plain_fold(log)]


def test_fold_of_odd_logs(spark):
    assert chat.fold(spark.createDataFrame([], LOG)).count() == 0
    rows = [(None, None, 1, 1, "open", None, None, None, None), (None, None, 1, 2, "delta", None, "t", None, None), (None, 5, 2, 0, "open", "user", None, None, None), (3, 0, 1, 1, "what", None, "x", None, None), (3, 1, 1, 1, None, None, "x", None, None), (4, 0, 0, 5, "remove", None, None, None, None)]
    got = sorted(chat.fold(spark.createDataFrame([(*r, "x") for r in rows], LOG)).select("conv_id", "turn", "role", "text").collect(), key=repr)
    assert [tuple(r) for r in got] == [(None, 5, "user", ""), (None, None, "", "t")]


def test_blocks_of_a_long_conversation(spark):
    """A regeneration voids messages thousands of turns later, and nothing before it."""
    n = 3 * chat.BLOCK
    log = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "0L AS message", "id AS seq", "'delta' AS kind", "'user' AS role", "cast(id AS string) AS text", "0L AS at", "0L AS n", "'' AS extra")
    again = spark.createDataFrame([(1, 10, 0, n + 1, "regenerate", "user", "", None, None, ""), (1, 10, 0, n + 2, "delta", "user", "new", None, None, ""), (1, n - 1, 0, n + 3, "delta", None, "last", None, None, "")], LOG)
    got = sorted((r.turn, r.text) for r in chat.fold(log.union(again)).collect())
    assert got == [(i, str(i)) for i in range(10)] + [(10, "new"), (n - 1, "last")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool\n", "[ROLE]"]), st.text(st.sampled_from("<>[]/\\sINTROLEY a\n"), max_size=24)), max_size=6))
def test_format_is_unambiguous(parts):
    """The whole formatted conversation gives back its turns, by a plain escape."""
    import re

    escape = lambda t: re.sub(chat._ESCAPE, r"\1\\\2\3", t)
    marks = chat.MARKS
    whole = "".join(marks[r][0] + escape(t) + marks[r][1] if r in marks else f"[ROLE]{escape(r)}[/ROLE]{escape(t)}[/ROLE]" for r, t in parts)
    assert list(chat.turns(whole)) == parts


def test_query_on_odd_conversations(spark, tmp_path):
    rows = [(1, None, "user", None), (1, 0, "assistant", "<s>\\</s> é😀"), (1, 0, None, "<\\s>"), (1, 2, "assistant", ""), (None, 1, "tool", "[ROLE]"), (None, 1, "tool", "[ROLE]"), (2, 2**62, "assistant", "big " * 50000), (2, -5, "system", "[SYS][\\/SYS]<\\\\s>")]
    rows += [(3, i, ["user", "assistant"][i % 2], f"[INST]{'x' * i}</s>") for i in range(60)]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:-1] for r in chat.op11_chat_format(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] != "assistant"))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[conv] == (len(own), sha(said), len(loss), sha(loss)), conv
    assert chat.read_back(chat.render(chat.fold(chat.history(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))))).count() == 0


def test_mask_covers_only_assistants(spark):
    got = chat.render(spark.createDataFrame([("user", "<s>a"), ("assistant", "<s>a</s>"), (None, None)], "role string, text string")).select("formatted", F.expr("substring(formatted, loss.start + 1, loss.end - loss.start)").alias("loss")).collect()
    assert [tuple(r) for r in got] == [("[INST]<\\s>a[/INST]", None), ("<s><\\s>a<\\/s></s>", "<\\s>a<\\/s>"), ("[ROLE][/ROLE][/ROLE]", None)]
