import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from stripweave.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, first_turn string, w string"
TRICKY = ["<|end|>\n", "<|turn:user|>\nx", "</s>[INST] ok [/INST]", r"[\INST] \<s> <\\|", "<<SYS>> a <</SYS>>", "[[INST]<<s>", "<", "\\", "", "|>\n<|past:x|>"]


def esc(text, pattern=r"([<\[])(\\*)" + C._TAIL, to=r"\1\\\2\3"):
    return re.sub(pattern, to, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<", "|", ">", "[", "]", "\\", "/", "INST", "SYS", "s", "x", "<s>", "[INST]"]), max_size=25).map("".join))
def test_escape_is_reversible(text):
    out = esc(text)
    assert re.sub(r"([<\[])\\(\\*)" + C._TAIL, r"\1\2\3", out) == text
    assert not any(c in out for c in ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>"))


def conversations(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"turn {t} " + "word " * (t * 7 % 90)) for t in range(60)]
    rows += [(2, 0, "system", "be brief " * 20)] + [(2, t, ["user", "assistant"][t % 2], TRICKY[t % 10] + " and " * (t % 40)) for t in range(1, 80)]
    rows += [(3, 0, "user", "long " * 900), (3, 1, "assistant", "longer " * 2000), (3, 2, "user", "thanks")]
    rows += [(4, None, None, None), (4, 1, "assistant", None), (None, 0, "user", "whose?"), (None, 1, "assistant", "mine"), (5, 0, "tool|x\n>", "odd role"), (5, 0, "tool|x\n>", "odd role"), (6, 3, "user", "late"), (6, 5, "system", "late system"), (6, 7, "assistant", "é😀")]
    return rows, spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def expected(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_and_budget(spark):
    rows, table = conversations(spark)
    for span in (512, 4):  # the second lays every conversation's sums in many parts
        made = C.windows(table, budget=200, history=40, span=span)
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in C.read_back(made).collect()}
        assert got == expected(rows)
        for w in made.collect():
            items = [re.match(r"(?s)<\|(\w+):", p)[1] for p in w["formatted"].split("<|end|>\n")[:-1]]
            assert items == sorted(items, key=["keep", "past", "turn"].index)
            assert w["n_tokens"] <= 200 or (w["oversize"] and items.count("turn") == 1), w["n_tokens"]
            for m in w["mask"]:
                assert w["formatted"][m["start"] + m["length"]:].startswith("<|end|>") and w["formatted"][: m["start"]].endswith("<|turn:assistant|>\n")
    assert {r["first_turn"] for r in made.where("conv_id = 2").collect()} != {1}
    assert all(r["formatted"].startswith("<|keep:system|>") for r in made.where("conv_id = 2 and first_turn > 1").collect())


def test_history_is_the_longest_that_fits(spark):
    _, table = conversations(spark)
    made = C.windows(table, budget=200, history=40).where("conv_id = 1").orderBy("first_turn").collect()
    turns = [C.OVERHEAD + 2 + t * 7 % 90 for t in range(60)]
    for w in made:
        past, total, k = 0, 0, w["first_turn"] - 2
        while k >= 0 and total + turns[k] <= 40:
            total, past, k = total + turns[k], past + 1, k - 1
        assert w["formatted"].count("<|past:") == past


def test_empty_and_report(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.windows(none).count() == 0
    r = C.chat_report(none).collect()
    assert [(x["conv_id"], x["n_turns"], x["loss_chars"]) for x in r] == [(-7, 2, 21)]
