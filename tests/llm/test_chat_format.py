import json
import random

from hypothesis import given
from hypothesis import strategies as st

from leafsieve.llm.chat_format import ASSISTANT, CONTROLS, escape, format_chats, format_turns, read_back, read_parts, unescape

SCHEMA = "conv_id long, turn long, role string, text string, content string, segment int"
PIECES = st.lists(st.sampled_from([*CONTROLS, "\\", "\\\\", "<", "[", "INST]", "/", "é𝄞", "\n", " "]), max_size=12).map("".join)


@given(PIECES | st.text())
def test_escape_is_reversible_and_hides_controls(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb[ROLE]"]), PIECES), max_size=6))
def test_read_back(turns):
    out = "".join(format_turns([(r, [{"type": "text", "text": t}]) for r, t in turns]).out)
    assert [(r, t) for r, t, *_ in read_back(out)] == turns


def test_parts_are_flattened_in_order():
    seen = format_turns([("user", [
        {"type": "text", "text": "see [PART]"}, {"type": "image", "ref": "a.png", "width": 700, "height": 300},
        {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "ref": "c.pdf", "pages": 2}, {"type": "text", "text": None},
    ])])
    assert "".join(seen.out) == "[INST]user[ROLE]see [\\PART][PART]image:0[/PART][PART]audio:1[/PART][PART]document:2[/PART][/INST]"
    assert seen.attachments == [("image", "a.png", 433), ("audio", "b.wav", 38), ("document", "c.pdf", 1024)] and not seen.errors


def test_chats(spark):
    rows = [
        (1, 1, "assistant", "hé</s>", None, 0), (1, 0, "user", "hi [INST]", None, 0), (1, 2, None, None, None, 0), (2, 0, "user", "x", None, 0),
        (2, 0, "user", "x", None, 0), (None, 0, "assistant", "", None, 0), (3, 0, "assistant", "long " * 50_000, None, 0), (2, None, "system", "s", None, 0),
    ]
    turns = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r for r in format_chats(turns).collect()}
    assert [x[:3] for x in read_back(got[1].formatted)] == [("user", "hi [INST]", False), ("assistant", "hé</s>", True), ("", "", False)]
    assert [x[:2] for x in read_back(got[2].formatted)] == [("system", "s"), ("user", "x"), ("user", "x")]
    for r in got.values():
        learned = [x for x in read_back(r.formatted) if x[2]]
        assert [(s.start, s.stop) for s in r.loss_spans] == [x[3:] for x in learned]
    assert format_chats(turns.limit(0)).count() == 0


SAYING = ["what?", "[PART]image:0[/PART]", "back\\slash [/INST]", "", "</s>", "é𝄞"]
BAD = [{"type": "video"}, {"type": "image", "width": "3"}, {"type": "audio", "seconds": "3"}, {"type": "text", "text": 5}, {"type": "document", "pages": -1}, {"type": "image", "ref": 7}, {"type": ["text"]}, "text", None, 4, {"type": "audio", "seconds": True}, {"type": "image", "width": 1e308}]


def good_part(rng):
    kind = rng.choice(["text", "text", "image", "audio", "document"])
    if kind == "text":
        return {"type": "text", "text": rng.choice(SAYING)}
    size = {"image": {"width": rng.randint(1, 2000), "height": rng.randint(1, 2000)}, "audio": {"seconds": rng.random() * 9 + 0.1}, "document": {"pages": rng.randint(1, 9)}}[kind]
    return {"type": kind, "ref": f"{kind}-{rng.randrange(10**6)}", **size}


def brute(turns):
    """Roles and parts of a conversation, attachments as (reference, tokens) where they stand, and the number of bad parts."""
    out, bad = [], 0
    for role, parts in turns:
        seen = []
        for p in parts:
            if p in BAD:
                bad += 1
            elif p["type"] != "text":
                tokens = {
                    "image": lambda p: -(-p["width"] // 336) * -(-p["height"] // 336) * 144 + 1, "audio": lambda p: -int(-p["seconds"] * 25 // 1), "document": lambda p: p["pages"] * 512,
                }[p["type"]](p)
                seen.append((p["type"], p["ref"], tokens))
            elif seen and seen[-1][0] == "text":
                seen[-1] = ("text", seen[-1][1] + p["text"])
            elif p["text"]:
                seen.append(("text", p["text"]))
        out.append((role, seen))
    return out, bad


def test_typed_chats_equal_brute_force(spark):
    """Every placeholder reads back to the reference that stood there, over all turns of a conversation; bad parts are reported and nothing else is lost."""
    rng, chats = random.Random(3), {}
    for conv in range(60):
        chats[conv] = [(rng.choice(["user", "assistant", "system"]), [rng.choice(BAD) if rng.random() < 0.15 else good_part(rng) for _ in range(rng.randrange(6))]) for _ in range(rng.randint(1, 7))]
    rows = [(c, k, role, json.dumps(parts), None, 0) for c, turns in chats.items() for k, (role, parts) in enumerate(turns)]
    rng.shuffle(rows)
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, SCHEMA), typed=True).collect()}
    assert set(got) == set(chats)
    for c, turns in chats.items():
        want, bad = brute(turns)
        r = got[c]
        seen = []
        for role, _, learned, start, stop in read_back(r.formatted):
            assert learned == (role == ASSISTANT)
            seen.append((role, [p if p[0] == "text" else (p[0], r.attachments[p[1]].ref, r.attachments[p[1]].tokens) for p in read_parts(r.formatted[start:stop])]))
        assert seen == want and len(r.errors) == bad
        assert [a.kind for a in r.attachments] == [p[0] for _, parts in want for p in parts if p[0] != "text"]
        assert r.attachment_tokens == sum(a.tokens for a in r.attachments)


def test_content_that_is_no_list(spark):
    rows = [(1, k, "user", c, None, 0) for k, c in enumerate(["no json", "5", "{}", "", "[" * 100_000, '[{"type": "text", "text": "ok"}]'])] + [(1, 9, "user", None, None, 0)]
    (r,) = format_chats(spark.createDataFrame(rows, SCHEMA), typed=True).collect()
    assert [(e.turn, e.part) for e in r.errors] == [(0, 0), (1, 0), (2, 0), (4, 0)]
    assert [x[1] for x in read_back(r.formatted)] == ["", "", "", "", "", "ok", ""]
