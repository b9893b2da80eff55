import re
import time

from docloom.llm import quotations as Q
from docloom.llm.queries import op1_quotation_linking


def test_query_links_each_turn_to_the_one_before(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet").collect()
    own = {r.conv_id * Q.MOST_TURNS + r.turn: r.text for r in turns}
    rows = op1_quotation_linking(spark, small).collect()
    assert sorted(r.msg_id for r in rows) == sorted(own)
    for r in rows:
        first = r.msg_id // Q.MOST_TURNS * Q.MOST_TURNS
        assert (r.parent_id, r.root_id, r.depth) == ((r.msg_id - 1 if r.msg_id > first else None), first, r.msg_id - first), r
        assert r.text == own[r.msg_id].strip("\n") and r.n_linked == r.n_quotes == min(2, r.msg_id - first)


def plain(rows):
    """{id: (parent, root, depth)} for messages of one thread, by dictionaries."""
    def parse(text):
        runs = []
        for line in (text or "").split("\n"):
            m = re.match(r" {0,3}((?:>[ \t]?)+)", line)
            normal = re.sub(r"[\s!-/:-@\[-`{-~]+", " ", line[m.end():] if m else line).lower().strip()
            if normal:
                level = m.group(1).count(">") if m else 0
                if runs and runs[-1][0] == level:
                    runs[-1][1].append(normal)
                else:
                    runs.append((level, [normal]))
        return runs

    whole, lines, parents = {}, {}, {}
    for i, text in sorted(rows):
        for level, part in parse(text):
            if not level:
                whole.setdefault("\n".join(part), i)
                for line in part:
                    lines.setdefault(line, i)
    for i, text in sorted(rows):
        votes = {}
        for level, part in parse(text):
            if level:
                at = whole.get("\n".join(part), 1 << 60)
                hits = len(part)
                if at >= i:
                    counts = {}
                    for line in part:
                        if lines.get(line, 1 << 60) < i:
                            counts[lines[line]] = counts.get(lines[line], 0) + 1
                    if not counts:
                        continue
                    at = max(counts, key=lambda k: (counts[k], -k))
                    hits = counts[at]
                votes[level, at] = votes.get((level, at), 0) + hits
        parents[i] = max(votes, key=lambda k: (-k[0], votes[k], k[1]))[1] if votes else None
    def chain(i):
        return [i] if parents[i] is None else [i, *chain(parents[i])]
    return {i: (parents[i], chain(i)[-1], len(chain(i)) - 1) for i in parents}


def test_nested_quotes_and_odd_rows(spark):
    rows = [(1, "Hello all,\nwho comes on Friday?\nBring cake."), (2, "> who comes on  FRIDAY\nI do."), (3, ">> who comes on Friday?\n> I do!\nMe too."),
            (4, "> > who comes on Friday?\n>> Bring cake\n> nobody said this\nNo."), (5, None), (6, ""), (7, "> Hello all\n> who comes on Friday?\n> bring cake\n\nok\n"),
            (8, ">" * 200 + " deep\n" + "> Me too.\n" * 500 + "x"), (9, "   > Me too.\n    > code, not a quote"), (10, "> only later\nq"), (11, "only later")]
    frame = spark.createDataFrame([(i, t, 3, "r") for i, t in rows], "msg_id long, text string, depth int, root string")
    got = Q.link_conversations(frame).collect()
    assert {r.id: (r.parent, r.root, r.depth) for r in got} == plain(rows)
    texts = {r.id: r.text for r in got}
    assert texts[3] == "Me too." and texts[5] is None and texts[7] == "ok" and texts[9] == "    > code, not a quote"
    again = spark.createDataFrame([(None, "> Bring cake"), (1, "Bring cake"), (2, "> Bring cake"), (2, "> Bring cake"), (2, "other")], "msg_id long, text string")
    assert sorted(((r.id, r.parent, r.root, r.depth) for r in Q.link_conversations(again).collect()), key=str) == sorted(
        [(None, None, None, 0), (1, None, 1, 0), (2, 1, 1, 1), (2, 1, 1, 1), (2, 1, 1, 1)], key=str)
    assert Q.link_conversations(frame.limit(0)).collect() == []


def test_common_lines_link_within_their_thread(spark):
    rows = [(t * 10 + k, t, text) for t in range(50) for k, text in enumerate(["Same opening.", "> Same opening.\nanswer"])]
    frame = spark.createDataFrame(rows, "msg_id long, thread long, text string")
    got = Q.link_conversations(frame, thread_column="thread").collect()
    assert all(r.parent == (r.id - 1 if r.id % 10 else None) for r in got)


def test_very_long_messages(spark):
    """Marks, blank lines and lines by the ten thousand: no recursion, and time in proportion."""
    rows = [(1, "start\nover"), (2, ">" * 100_000 + " deep\nx"), (3, "> start\n> over\n\n" + "\n \t\n" * 100_000 + "a" + "\n" * 100_000 + "b\n \n"),
            (4, "\n".join("> start\nown" + str(k) for k in range(10_000)))]
    frame = spark.createDataFrame(rows, "msg_id long, text string")
    start = time.time()
    got = {r.id: r for r in Q.link_conversations(frame).collect()}
    assert time.time() - start < 30
    assert got[2].n_quotes == 1 and got[2].text == "x"
    assert (got[3].parent, got[3].n_quotes, got[3].n_linked) == (1, 1, 1) and got[3].text == "a" + "\n" * 100_000 + "b"
    assert (got[4].parent, got[4].n_quotes, got[4].n_linked) == (1, 10_000, 10_000) and got[4].text.count("\n") == 9_999
