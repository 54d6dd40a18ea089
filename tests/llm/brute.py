"""Plain versions of the operators on lists in memory, and a small corpus for them."""
import random

SPACE = b" \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def corpus(seed=1, n=150):
    """(id, text) with shared passages, near copies, near lines, repeats, junk, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßz") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["Und", "&", "#x", "é,"]
    phrase = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line, base = phrase(70), phrase(12), phrase(90)
    out = []
    for i in range(n):
        lines = [phrase(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        kind = i % 10
        if kind == 0:
            lines.insert(rng.randint(0, len(lines)), phrase(rng.randint(0, 9)) + " " + passage)
        elif kind == 1:
            w = base.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            lines = [" ".join(w)]
        elif kind == 2:
            w = line.split()
            edit = rng.randint(0, 3)
            if edit == 0:
                w[rng.randrange(len(w))] = "other"
            elif edit == 1:
                del w[rng.randrange(len(w))]
            elif edit == 2:
                w.insert(rng.randrange(len(w)), "more")
            lines.insert(0, " ".join(w))
        elif kind == 3 and i > 20:
            lines = [rng.choice(out)[1] or ""]
        elif kind == 4:
            lines = ["x " * 60 + phrase(3)]
        elif kind == 5:
            lines += ["", "  ", lines[0], "\t" + phrase(2).upper()]
        out.append((i * 3, "\n".join(lines)))
    return out + [(100_001, None), (100_002, ""), (100_003, " \n\t "), (100_004, "one"), (100_005, "One"), (100_006, passage + " " + phrase(6000))]


def rule_statistics(text):
    t = text or ""
    w = words(t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(set(windows)) < len(windows) else set()
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), sum("A" <= c <= "Z" for c in t), len(lines),
            len(lines) - len(set(lines)), len(covered))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def drop_lines(docs, same=3, near=8):
    """{id: (kept text, lines, removed)} for (id, text) in any order."""
    seen, out = [], {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        if text is None:
            out[i] = (None, 0, 0)
            continue
        kept = []
        for line in text.split("\n"):
            w = words(line)
            if len(w) >= same and any(w == x or min(len(w), len(x)) >= near and abs(len(w) - len(x)) < 2 and edit_distance(w, x) < 2 for x in seen):
                seen.append(w)
                continue
            if len(w) >= same:
                seen.append(w)
            kept.append(line)
        n = len(text.split("\n"))
        out[i] = (text if len(kept) == n else "\n".join(kept), n, n - len(kept))
    return out


def removed_words(docs, window=50):
    """{id: mask of removed words}."""
    first = {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out[i] = gone
    return out


def shingles(text, size):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.decode()) for x in words(text)]
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def near_components(docs, size, percent):
    """{id: (set size, component)}."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def best_fit(lengths, sizes, cost):
    """(contents, capacity) of each bin, in order of opening, one item at a time in descending order."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [(size - sum(held), k) for k, (size, held) in enumerate(bins) if size - sum(held) >= length]
        if fits:
            bins[min(fits)[1]][1].append(length)
        else:
            bins.append((min((s for s in sizes if s >= length), key=lambda s: (cost(s) / s, s)), [length]))
    return [(tuple(held), min((s for s in sizes if s >= sum(held)), key=lambda s: (cost(s), s))) for _, held in bins]


def slots(names, size, offset_and_skip):
    """Owner of each slot, filled turn by turn."""
    owner, orders = [None] * size, []
    for name in sorted(names):
        offset, skip = offset_and_skip(name)
        orders.append(iter([(offset + j * skip) % size for j in range(size)]))
    for turn in range(size):
        name = sorted(names)[turn % len(names)]
        owner[next(s for s in orders[turn % len(names)] if owner[s] is None)] = name
    return owner
