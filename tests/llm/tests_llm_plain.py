"""Plain versions that operators are held against."""

import re

import xxhash


def plain_normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", plain_lower(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(rows, distance=3):
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= distance:
                label[root(i)] = root(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append(min(ids, default=None))
    return out


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain_lower(text))


def plain_contaminated(text, items, width=10):
    w = plain_words(text)
    for item in map(plain_words, items):
        n = min(width, len(item))
        windows = {tuple(item[a : a + n]) for a in range(len(item) - n + 1)} if n else set()
        if any(tuple(w[a : a + n]) in windows for a in range(len(w) - n + 1)):
            return True
    return False


def plain_survivors(rows):
    """Brute force over all pairs of rows."""
    words = [(r[1] or "").lower().split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == k) for k in set(label))
