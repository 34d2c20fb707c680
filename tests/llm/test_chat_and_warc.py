"""Chat formatting and WARC archives."""

import hashlib
import itertools
import random

import pytest

from quire.llm import chat, warc

TURNS = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, url string, html string"


# --- chat


def legal(roles):
    body = roles[1:] if roles[:1] == ("system",) else roles
    return (not roles) or (len(body) % 2 == 0 and len(body) > 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body)))


def brute_cost(roles):
    """Least cost over all ways: each turn gets a role or is merged, then empty turns are added where they make it legal."""
    best = None
    for deeds in itertools.product(("system", "user", "assistant", "merge"), repeat=len(roles)):
        cost, kept = 0, []
        for r, d in zip(roles, deeds, strict=True):
            if d == "merge":
                if not kept:
                    cost = None
                    break
                cost += chat.MERGE + (0 if chat.role_state(r) == chat.ROLES.index(kept[-1][0]) + 1 else chat.RELABEL)
                kept[-1] = (kept[-1][0], True)
            else:
                kept.append((d, False))
                cost += 0 if chat.role_state(r) == chat.ROLES.index(d) + 1 else chat.RELABEL
        if cost is None:
            continue
        added = insertions(tuple(k for k, _ in kept))
        if added is not None and (best is None or cost + chat.INSERT * added < best):
            best = cost + chat.INSERT * added
    return best


def insertions(roles, limit=9):
    """Fewest roles that must be added to make roles legal."""
    for n in range(limit):
        for total in [len(roles) + n]:
            for head in ((), ("system",)):
                body = total - len(head)
                if body < 0 or body % 2 or (body == 0 and total):
                    continue
                want = head + ("user", "assistant") * (body // 2)
                it = iter(want)
                if all(r in it for r in roles):
                    return n
    return None


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_costs_equal_brute_force(n):
    for roles in itertools.product(("system", "user", "assistant", None), repeat=n):
        states = [chat.role_state(r) for r in roles]
        piece = chat.render([(s, f"t{k}") for k, s in enumerate(states)], chat.START, chat.END_COST, True)
        assert piece["cost"] == brute_cost(roles), roles
        told = tuple(x.split("|>")[0] for x in piece["rendered"].split("<|") if x.split("|>")[0] in chat.ROLES)
        assert legal(told), (roles, told)
        assert all(f"t{k}" in piece["rendered"] for k in range(n))


GAPS = {("", "system"): [], ("", "user"): [], ("", "assistant"): ["user"], ("system", "user"): [], ("system", "assistant"): ["user"], ("user", "assistant"): [], ("user", "user"): ["assistant"], ("assistant", "user"): [], ("assistant", "assistant"): ["user"]}
ENDS = {"": [], "system": ["user", "assistant"], "user": ["assistant"], "assistant": []}


def brute_repair(roles):
    """All ways, turn by turn: of the cheapest the first in the order keep, merge, relabel, insert; as (cost, list of (role, numbers of turns))."""
    ways = [(0, (), "", ())]  # cost, preferences so far, open role, shape
    for k, r in enumerate(roles):
        new = []
        for cost, told, state, shape in ways:
            if state:
                new.append((cost + 1 + 2 * (r != state), (*told, (1, 1 + 2 * (r != state), 0)), state, (*shape[:-1], (state, (*shape[-1][1], k)))))
            for to in ("system", "user", "assistant"):
                gap = GAPS.get((state, to))
                if gap is not None:
                    step = 3 * len(gap) + 2 * (r != to)
                    rank = 3 if gap else 0 if r == to else 2
                    new.append((cost + step, (*told, (rank, step, ("system", "user", "assistant").index(to))), to, (*shape, *((g, ()) for g in gap), (to, (k,)))))
        ways = new
    cost, _, state, shape = min(((c + 3 * len(ENDS[s]), t, s, x) for c, t, s, x in ways), key=lambda w: w[:2])
    return cost, [*shape, *((x, ()) for x in ENDS[state])]


def shown(shape, texts):
    return "\n".join(f"<|{role}|>\n" + "\n".join(texts[k] for k in ks) + "\n<|end|>" for role, ks in shape) + "\n"


def joined(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.chunk)):
        c = found.setdefault(r.conv_id, {"rendered": "", "turns": 0, "merged": 0, "relabelled": 0, "inserted": 0, "cost": 0, "chunks": []})
        for k in ("rendered", "turns", "merged", "relabelled", "inserted", "cost"):
            c[k] += r[k]
        c["chunks"].append(r.chunk)
    return found


def test_repaired_text_does_not_depend_on_chunks(spark):
    """1,000 conversations cut into chunks of 1, 2, 7 and 256 turns: one text, which is the brute force's where that is small enough."""
    rng, kinds = random.Random(4), ["user", "assistant", "system", None]
    roles = [[rng.choice(kinds) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 30]))] for _ in range(1000)]
    roles[0] = ["assistant"] * 4 + ["system", None, "assistant", None]
    turns = spark.createDataFrame([(c, t, r, f"c{c}t{t}") for c, own in enumerate(roles) for t, r in enumerate(own)], TURNS).repartition(4)
    found = {n: joined(chat.format_chats(turns, chunk=n).collect()) for n in (1, 2, 7, 256)}
    for n in (1, 2, 7):
        assert all(v["chunks"] == list(range(len(v["chunks"]))) for v in found[n].values())
        for c, v in found[256].items():
            assert {k: x for k, x in found[n][c].items() if k != "chunks"} == {k: x for k, x in v.items() if k != "chunks"}, (n, c)
    for c, own in enumerate(roles):
        if len(own) <= 6:
            cost, shape = brute_repair(own)
            assert (found[256][c]["cost"], found[256][c]["rendered"]) == (cost, shown(shape, [f"c{c}t{t}" for t in range(len(own))])), own


def test_a_long_conversation_is_cut_into_pieces_of_many_tasks(spark):
    rng = random.Random(5)
    rows = [(7, t // 3, rng.choice(["user", "assistant", "system", "odd"]), f"t{t:05d}") for t in range(6000)] + [(8, 0, "user", "one")]
    turns = spark.createDataFrame(rows, TURNS).repartition(8)
    whole, cut = (joined(chat.format_chats(turns, chunk=n).collect()) for n in (10_000, 16))
    assert len(cut[7]["chunks"]) > 300 and {k: v for k, v in cut[7].items() if k != "chunks"} == {k: v for k, v in whole[7].items() if k != "chunks"} and cut[8] == whole[8]


def test_chat_edge_cases(spark):
    rows = [(1, None, "user", None), (1, None, "user", None), (None, 0, "assistant", "x"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "y" * 200_000), (3, -5, "user", "first"), (3, 700, "gpt", "last")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], TURNS + ", cost string")
    found = {}
    for r in chat.format_chats(turns).collect():
        found.setdefault(r.conv_id, []).append(r)
    assert found.keys() == {1, None, 2, 3}
    assert (found[2][0].merged, found[2][0].cost) == (1, 1)
    assert sum(r.cost for r in found[3]) == 0 and len(found[3]) == 1 and found[3][0].turns == 2
    assert found[None][0].inserted == 1 and found[None][0].rendered.startswith("<|user|>\n\n<|end|>")
    assert chat.format_chats(spark.createDataFrame([], TURNS)).collect() == []


def test_chat_turns_without_numbers_are_parted(spark):
    """Nulls and repeated turn numbers make no chunk longer than the others, and the order holds over the pieces."""
    rows = [(1, None, ("user", "assistant", "odd")[k % 3], f"n{k:04d}") for k in range(300)] + [(1, 0, "user", "same")] * 100 + [(None, 5, "user", f"z{k:03d}") for k in range(50)] + [(2, 0, "user", "one")]
    turns = spark.createDataFrame(rows, TURNS).repartition(4)
    whole = {r.conv_id: r for r in chat.format_chats(turns, chunk=1000).collect() if r.conv_id != 1}
    found = sorted(chat.format_chats(turns, chunk=16).collect(), key=lambda r: (r.conv_id or 0, r.chunk))
    assert max(r.turns for r in found) <= 16 and sum(r.turns for r in found) == len(rows) and len({(r.conv_id, r.chunk) for r in found}) == len(found)
    for c, r in whole.items():
        assert "".join(p.rendered for p in found if p.conv_id == c) == r.rendered and sum(p.cost for p in found if p.conv_id == c) == r.cost
    text = "".join(p.rendered for p in found if p.conv_id == 1)
    at = [text.index(t) for _, _, _, t in sorted(rows[:300], key=lambda x: (x[2], x[3]))]
    assert at == sorted(at) and at[-1] < text.index("same") and text.count("same") == 100


# --- WARC


def page_rows():
    long = "é" * 80 + "<p>"
    return [(1, "http://a/", None), (2, None, ""), (3, "http://c/\r\nX: y", long), (4, "http://d/", long), (5, "http://é/", "short"), (6, "http://f/", "short"), (7, "http://g/", "z" * 300_000), (8, "http://g/", "z" * 300_000), (9, "http://h/", "\r\n\r\n" * 40)]


def test_archives_read_back_what_was_written(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1) for r in page_rows()], PAGES + ", payload int").repartition(3)
    manifest = warc.write_archives(pages, str(tmp_path / "a"), roll_bytes=200).collect()
    assert len(manifest) > 3 and sum(r.records for r in manifest) == 9
    assert not (tmp_path / "a" / "_temporary").exists()
    read = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    for i, url, html in page_rows():
        body = (html or "").encode()
        r = read[i]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(body), hashlib.sha256(body).hexdigest(), url or "")
        want = {4: 3, 8: 7}.get(i)
        assert (r.record_type, r.refers_to) == (("revisit", want) if want else ("response", None))
        assert r.payload is None if want else bytes(r.payload) == body


def test_archives_are_the_same_every_time(spark, tmp_path):
    rows = page_rows()
    for name, order in (("a", rows), ("b", rows[::-1])):
        warc.write_archives(spark.createDataFrame(order, PAGES), str(tmp_path / name))
    told = [{r.file: (r.sha256, r.records) for r in warc.read_manifest(spark, str(tmp_path / n)).collect()} for n in ("a", "b")]
    assert told[0] == told[1]


def test_files_outside_the_manifest_are_ignored_and_damage_is_found(spark, tmp_path):
    folder = tmp_path / "a"
    warc.write_archives(spark.createDataFrame(page_rows(), PAGES), str(folder))
    (folder / "part-000099-00000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read_archives(spark, str(folder)).count() == 9
    name = warc.read_manifest(spark, str(folder)).first().file
    (folder / name).write_bytes((folder / name).read_bytes()[:-9])
    with pytest.raises(Exception, match="differs from its manifest"):
        warc.read_archives(spark, str(folder)).collect()


def test_archive_edge_tables(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).collect() == []
    body = "x" * 200
    rows = [(5, "u", body), (5, "u", body), (None, "n", body), (6, "v", body)]
    warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "ties"))
    found = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(spark, str(tmp_path / "ties")).collect()), key=str)
    assert found == sorted([(5, "response", None)] * 2 + [(None, "revisit", 5), (6, "revisit", 5)], key=str)
