"""Near copies and leaks decided pair by pair, for comparison."""

import collections


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    lead = list(range(len(rows)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                lead[find(i)] = find(j)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            first[find(i)] = min(first.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), first.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)]


def bag(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else [], k, w


def brute_leaks(docs, items):
    found = {}
    for item_id, text in items:
        want, k, _ = bag(text)
        if not want:
            continue
        need = collections.Counter(want)
        for doc_id, body in docs:
            w = (body or "").lower().split()
            has = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            if not set(has) & set(need):
                continue
            for a in range(max(1, len(has) - len(want) + 1)):
                window = collections.Counter(has[a : a + len(want)])
                both = sum((window & need).values())
                if 5 * both >= 4 * (sum(window.values()) + len(want) - both):
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), both / (sum(window.values()) + len(want) - both))
    return found
