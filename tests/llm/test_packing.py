from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from spanwarden.llm import packing


def brute(sizes, capacities):
    """The rule written out: scan all open bins, and simulate filling for each capacity."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    rooms, used, place = [], [], {}
    for n, i in enumerate(order):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            best = None
            for c in sorted(c for c in capacities if c >= sizes[i]):
                held = sizes[i]
                for j in order[n + 1 :]:
                    if held + sizes[j] <= c:
                        held += sizes[j]
                ratio = packing.cost(c) / held
                if best is None or ratio < best[0]:
                    best = (ratio, c)
            b = len(rooms)
            rooms.append(best[1])
            used.append(0)
        place[i] = (b, used[b])
        used[b] += sizes[i]
        rooms[b] -= sizes[i]
    return [(*place[i], min(c for c in capacities if c >= used[place[i][0]])) for i in range(len(sizes))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=40))
def test_matches_brute_force(sizes):
    assert packing.pack(sizes, (8, 16, 32)) == brute(sizes, (8, 16, 32))


def test_table(docs):
    texts = [None, "", "a b c", "w " * 9000, "x", "x"] + ["t " * (k * 37 % 700) for k in range(60)]
    rows = packing.pack_documents(docs(texts, [None, *range(1, len(texts))]), shard_pieces=40).collect()
    tokens = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        tokens[r["doc_id"]] += r["n_tokens"]
        bins[r["shard"], r["bin"]].append((r["bin_offset"], r["n_tokens"], r["capacity"]))
    assert dict(tokens) == {None if not i else i: len((t or "").split()) + 1 for i, t in enumerate(texts)}
    for own in bins.values():
        own.sort()
        end = 0
        for offset, n, capacity in own:
            assert offset == end
            end += n
        assert end <= capacity and not any(end <= c < capacity for c in packing.LENGTHS)
    assert len({s for s, _ in bins}) > 1


def test_empty(docs):
    assert packing.pack_documents(docs([])).collect() == []
