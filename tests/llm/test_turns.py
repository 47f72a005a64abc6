import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeweave.llm import chat_format, turn_repair
from citeweave.llm.chat_format import GrammarError, Template, parse, rendered

TURNS = "conv_id long, turn long, role string, text string"
CONTROLS = [*Template().controls, "\\", "[", "<", "/", "a", " ", "é", "\n", "(", ")", "|", ">"]
CLASH = Template(marks={"user": ("<<", ">>"), "assistant": ("<|", "|>")}, other=("((", "))", "()"), learned=("assistant",))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool[TEXT]", "\\"]), st.lists(st.sampled_from(CONTROLS), max_size=8).map("".join)), max_size=6))
@pytest.mark.parametrize("template", [Template(), CLASH])
def test_rendered_turns_come_back(template, turns):
    pieces = [rendered(template, role, text) for role, text in turns]
    text = "".join(p[0] for p in pieces)
    assert [(r, t) for r, t, _, _ in parse(template, text)] == turns


def test_only_conflicting_content_is_escaped():
    template = Template()
    assert rendered(template, "user", "a [b] <c>") == ("[INST]a [b] <c>[/INST]", 6, 15)
    assert rendered(template, "user", "[/INST]")[0] == "[INST]\\[/INST][/INST]"
    assert rendered(template, "assistant", "a\\")[0] == "<s>a\\\\</s>"
    # the last "(" and the closing mark make the mark "((", which only the second level escapes
    assert rendered(CLASH, "tool", "a(")[0] == "((tool))a\\(()"
    for text in ("[INST]a", "a[/INST]", "[INST]a</s>", "[INST]a\\"):
        with pytest.raises(GrammarError):
            [*parse(template, text)]
    for bad in ({"user": ("", "b")}, {"user": ("a\\", "b")}, {"user": ("a", "b"), "x": ("ab", "c")}, {"user": ("a", "b"), "x": ("a", "c")}):
        with pytest.raises(ValueError):
            Template(marks=bad)


def formatted_of(rows):
    """What the format query must return, from sorted (role, text) rows."""
    learned = "".join(t for r, t in rows if r == "assistant")
    text = "".join(rendered(Template(), r, t)[0] for r, t in rows)
    return len(rows), sha("".join(f"{r}\n{t}\n" for r, t in rows)), len(learned), sha(learned), len(text)


def long_talk(conv, n, seed):
    draw = random.Random(seed)
    said = ["Yes.", "No!", "what", "", "  ", "Is it?  ", "</s>[INST]", "é日 ok."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool"]
    return [(conv, k, draw.choice(roles), draw.choice(said) + (str(draw.randrange(900)) if draw.random() < 0.7 else "") + draw.choice(["", "."])) for k in range(n)]


def test_long_conversation_is_formatted_in_pieces(spark):
    rows = long_talk(1, 9000, 1) + long_talk(2, 3, 2) + long_talk(None, 5, 3) + [(4, None, None, None), (4, 0, "user", "x" * 3_000_000)]
    data = spark.createDataFrame(rows, TURNS).repartition(5)
    output = chat_format.formatted(data)
    assert output.where("conv_id = 1").count() > 4 and output.where("conv_id = 1 and whole").count() == 0
    got = {r[0]: tuple(r)[1:] for r in chat_format.round_trip(data).collect()}
    of = lambda c: [(r or "", t or "") for k, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1]))]
    assert got == {c: formatted_of(of(c)) for c in (1, 2, None, 4)}


def test_written_output_gives_the_turns_back(spark, tmp_path):
    rows = long_talk(7, 40, 4) + [(8, 0, "assistant", "[/INST]"), (8, 0, "assistant", "[/INST]")]
    path = "file://" + str(tmp_path / "out")
    chat_format.write_formatted(spark.createDataFrame(rows, TURNS), path)
    turns = chat_format.recovered(spark.read.parquet(path)).orderBy("conv_id", "place", "number").collect()
    assert [(t.conv_id, t.role, t.text, t.learned) for t in turns] == [(c, r, x, r == "assistant") for c, _, r, x in rows]


def test_formats_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert chat_format.round_trip(empty).collect() == [] and turn_repair.repair_damage(empty).collect() == []
    extra = spark.createDataFrame([(1, 0, "user", "a.", 5, "x", 2)], TURNS + ", digest int, conv string, copies int")
    assert chat_format.round_trip(extra).collect()[0].n_turns == 1
    assert turn_repair.repair_damage(extra).count() == 1
    named = spark.createDataFrame([("a", 0, "user", "hi.")], TURNS.replace("conv_id long", "conv_id string"))
    assert chat_format.round_trip(named).collect()[0].conv_id == "a" and turn_repair.repair_damage(named).collect()[0].conv_id == "a"


# --- repair


def simulated(rows):
    """Damage, counts and the cheapest repair of one conversation's (conv, turn, role, text) rows, whole audits kept."""
    space = lambda x: " " if x is None else str(x)
    after = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if fault == 4 else space(role), space(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        after += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return judged_rows(after)


def judged_rows(after):
    seen, facts, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in after:
        visible = text.rstrip(" \t\n\x0b\f\r")
        kind = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
        seen.add((role, text))
        if kind:
            n[kind] += 1
        facts.append((role, text, kind))
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
    cost, audit, text = cheapest(facts)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha(text)


def cheapest(facts):
    """(cost, audit, text) by keeping the best whole audit of each automaton state."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for q, (cost, audit, rows) in list(out.items()):
                for r in "ua":
                    if (q, r) in step:
                        new = (cost + 2, audit + "I", (*rows, names[r] + ":"))
                        out[r] = min(out.get(r, (1 << 40, "", ())), new)
        return out

    for role, text, kind in facts:
        new = {q: (c + 3, a + "D", rows) for q, (c, a, rows) in best.items()}
        if kind not in ("blank", "duplicate"):
            more = kind == "truncated"
            for q, (cost, audit, rows) in inserted(best).items():
                for r, letter, price in [(role[:1], "K", 0), ("u", "R", 2), ("a", "R", 2)]:
                    if (q, r) in step:
                        name = role if letter == "K" else names[r]
                        new[r] = min(new.get(r, (1 << 40, "", ())), (cost + price + more, audit + letter, (*rows, f"{name}:{text}")))
        best = new
    cost, audit, rows = min(v for q, v in inserted(best).items() if q in ("", "a"))
    return cost, audit, "\n".join(rows)


def exhaustive(facts):
    """The least (cost, audit) over all edits with up to two inserts before each row and at the end."""
    found = []
    for way in itertools.product("DKua", repeat=len(facts)):
        if any(w != "D" and f[2] in ("blank", "duplicate") for w, f in zip(way, facts, strict=True)):
            continue
        price = sum(3 if w == "D" else (w != "K") * 2 + (f[2] == "truncated") for w, f in zip(way, facts, strict=True))
        for extra in itertools.product(["", "u", "a", "ua", "au"], repeat=len(facts) + 1):
            roles, audit = "", ""
            for w, f, e in zip([*way, ""], [*facts, None], extra, strict=True):
                roles += e + ("" if w in ("", "D") else f[0][:1] if w == "K" else w)
                audit += "I" * len(e) + (w if w in ("", "D", "K") else "R")
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((price + 2 * len("".join(extra)), audit))
    return min(found)


def test_repair_is_the_least_of_all(spark):
    draw = random.Random(5)
    for _ in range(40):
        facts = [(draw.choice(["user", "assistant", "system"]), "x", draw.choice(["", "", "blank", "truncated"])) for _ in range(draw.randint(0, 3))]
        best = turn_repair.Repair([(r[:1], k == "blank", k == "truncated") for r, _, k in facts], turn_repair.START)
        cost, _, last = min((best.cost[t] + 2 * turn_repair._AT_END[t], best.rank[t], t) for t in range(4))
        audit = best.audit(last) + "I" * turn_repair._AT_END[last]
        assert (cost, audit) == exhaustive(facts) == cheapest(facts)[:2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaxuauaua"), st.booleans(), st.booleans()), max_size=24), st.data())
def test_segments_chain_to_the_whole(rows, data):
    import numpy as np

    cuts = sorted(data.draw(st.lists(st.integers(0, len(rows)), max_size=4)))
    parts = [rows[a:b] for a, b in itertools.pairwise([0, *cuts, len(rows)])]
    ways = [[turn_repair.Repair(p, s) for s in range(4)] for p in parts]
    cost, chosen = turn_repair.chain([np.array([c for w in p for c in w.cost] + [r for w in p for r in w.rank]) for p in ways])
    audit = "".join(p[s].audit(t) for p, (s, t) in zip(ways, chosen, strict=True)) + "I" * turn_repair._AT_END[chosen[-1][1]]
    names = {"s": "system", "u": "user", "a": "assistant", "x": "x"}
    facts = [(names[r], "t", "blank" if gone else "truncated" if cut else "") for r, gone, cut in rows]
    assert (cost, audit) == cheapest(facts)[:2]


def test_long_conversations_are_repaired_in_segments(spark):
    rows = long_talk(1, 7000, 6) + [r for c in range(2, 60) for r in long_talk(c, c % 9, c)] + long_talk(None, 6, 9)
    rows += [(70, None, "user", "a."), (70, None, "user", "a."), (70, None, None, None), (71, None, "tool", "x"), (72, 3, "", "x."), (72, 9, "assistant", "x.")]
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repair_damage(spark.createDataFrame(rows, TURNS).repartition(5)).collect()}
    convs = {r[0] for r in rows}
    assert set(got) == convs
    for conv in convs - {70}:
        assert got[conv] == simulated([r for r in rows if r[0] == conv]), conv


def test_equal_texts_far_apart_are_duplicates(spark):
    """The first of equal rows may stand in another range than the rest; one text makes up the whole conversation."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "Same text.") for k in range(6000)]
    got = turn_repair.repair_damage(spark.createDataFrame(rows, TURNS)).collect()
    assert tuple(got[0])[1:] == simulated(rows)


def test_everything_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = turn_repair.repair_damage(spark.createDataFrame([(conv, 0, "user", "hi.")], TURNS)).collect()
    assert tuple(got[0]) == (conv, 0, 0, 0, 0, 0, 0, "", sha(""))
