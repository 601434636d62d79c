import random
import re
from collections import Counter, defaultdict

from quarry.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, path string, own int"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(chat.conversations(df).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.position))


def test_replies_follow_what_they_quote(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "Another message."), (1, 2, "assistant", "On Monday Ann wrote:\n> Hello there\n> How are you?\nFine.\n"), (1, 3, "user", "> > hello  THERE\n> Fine.\nGood."),
        (1, 4, "user", "> Another message.\nok"), (1, 5, "user", "> How are you?\nlate"), (1, 6, "user", "> nobody wrote this\nhm"), (1, 7, "user", "> late\n>> How are you?\n>>> Hello there\ndeep"),
    ]
    got = run(spark, rows)
    assert [(r.turn, r.parent_turn, r.depth) for r in got] == [(0, None, 0), (2, 0, 1), (3, 2, 2), (5, 0, 1), (7, 5, 2), (1, None, 0), (4, 1, 1), (6, None, 0)]
    assert [r.text for r in got] == ["Hello there\nHow are you?", "Fine.", "Good.", "late", "deep", "Another message.", "ok", "hm"]
    assert [r.n_quotes for r in got] == [0, 1, 2, 1, 3, 0, 1, 1]


def test_a_long_thread(spark):
    n = 40
    rows = [(7, i, "user", (f"> message {i - 1}\n" if i else "") + f"message {i}") for i in range(n)] + [(8, i, "user", "same") for i in range(n)]
    got = run(spark, rows)
    assert [(r.turn, r.depth, r.parent_turn, r.text) for r in got[:n]] == [(i, i, i - 1 if i else None, f"message {i}") for i in range(n)]
    assert [(r.turn, r.depth, r.position) for r in got[n:]] == [(i, 0, i) for i in range(n)]


def test_nulls_repeats_and_markers(spark):
    rows = [(None, 0, "user", "> x"), (2, None, "user", "> y\nz"), (2, 0, None, None), (2, 1, "user", "a <|im_end|> b"), (2, 1, "user", "a <|im_end|> b"), (2, 2, "user", "> a <|im_end|> b\nreply"), (3, 0, "user", "")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert [r.segment for r in got if r.turn == 1] == ["<|im_start|>user\na < |im_end|> b<|im_end|>\n"] * 2
    assert [(r.parent_turn, r.text) for r in got if r.turn == 2] == [(1, "reply")]
    assert [(r.text, r.segment) for r in got if r.role is None] == [(None, "<|im_start|>unknown\n<|im_end|>\n")]
    assert run(spark, []) == []


def test_without_quotes_nothing_changes(spark):
    sf = "/root/testdata/sf0.001"
    rows = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = chat.query(spark, sf).collect()
    assert len(got) == len(rows)
    assert all(r.text == rows[r.conv_id, r.turn].text and r.role == rows[r.conv_id, r.turn].role for r in got)


def brute(rows):
    """conv_id -> [(turn, parent, depth, text, n_quotes, n_linked)] in reply order, for distinct turns."""
    first, parsed = {}, {}
    for conv, turn, _, text in sorted(rows):
        runs, own, lines = [], [], text.split("\n")
        levels = [re.match(r"(?:[ \t]*>)*", x)[0].count(">") for x in lines] + [0]
        for x, level, after in zip(lines, levels, levels[1:]):
            body = re.sub(r"^(?:[ \t]*>)*", "", x)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
            if not level and not (after and x.endswith("wrote:")):
                own.append(x)
        units = {(level, " ".join(t.lower().split())) for level, bodies in runs for t in ["\n".join(bodies), *bodies]}
        parsed[conv, turn] = units, "\n".join(own).strip("\n") if max(levels) else text, sum(level > 0 for level, _ in runs)
        for level, unit in units:
            if not level and unit:
                first.setdefault((conv, unit), turn)
    children, told = defaultdict(list), {}
    for (conv, turn), (units, own, quotes) in sorted(parsed.items()):
        found = [(level, first[conv, u], len(u)) for level, u in units if level and first.get((conv, u), turn) < turn]
        sizes = Counter()
        for level, of, size in found:
            sizes[level, of] += size
        parent = max(sizes, key=lambda k: (-k[0], sizes[k], k[1]))[1] if sizes else None
        children[conv, parent].append(turn)
        told[conv, turn] = parent, own, quotes, len(found)
    out = defaultdict(list)
    for conv in {c for c, _ in parsed}:
        held = [(t, 0) for t in reversed(children[conv, None])]
        while held:
            turn, depth = held.pop()
            parent, own, quotes, linked = told[conv, turn]
            out[conv].append((turn, parent, depth, own, quotes, linked))
            held += [(t, depth + 1) for t in reversed(children[conv, turn])]
    return out


def trees(seed, conversations=25, turns=30):
    """Conversations whose messages quote passages or lines of earlier ones, quotes within included."""
    r, rows = random.Random(seed), []
    for conv in range(conversations):
        said = []
        for turn in range(turns if conv % 5 else 1 + conv):
            lines = []
            for _ in range(r.choice([0, 1, 1, 2])):
                if said:
                    of = r.choice(said if conv % 2 else said[-1:])
                    part = of.split("\n")
                    part = part if r.random() < 0.6 else [r.choice(part)]
                    lines += ["On Monday Ann wrote:"] if r.random() < 0.3 else []
                    lines += [r.choice([">", "> ", " > "]) + (x.upper() if r.random() < 0.2 else x) for x in part]
                    lines += [f"between {conv} {turn}"] if r.random() < 0.5 else []
            lines += [r.choice([f"word {r.randrange(12)} of {conv}", f"line {r.randrange(40)}  here", "thanks", ""]) for _ in range(r.randrange(1, 4))]
            said.append("\n".join(lines))
            rows.append((conv, turn, "user", said[-1]))
    r.shuffle(rows)
    return rows


def test_random_quote_trees_against_brute_force(spark):
    rows = trees(1)
    want, got = brute(rows), defaultdict(list)
    for r in run(spark, rows):
        assert r.position == len(got[r.conv_id])
        got[r.conv_id].append((r.turn, r.parent_turn, r.depth, r.text, r.n_quotes, r.n_linked))
    assert got == want
    assert sum(x[1] is not None for g in got.values() for x in g) > 200 and max(x[2] for g in got.values() for x in g) >= 8
