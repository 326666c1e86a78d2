"""Brute-force versions that the tests compare with."""

import hashlib
import random
import re
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, kept string, fp string, uid string"
WORDS = "the of and to in that was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, texts):
    """Documents (id, text) with columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", len(t) if t else 0, "k", "i", "no", "f", "u") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def brute_dedup(rows):
    """(doc_id, keep_id, group_size, sha) by plain grouping."""
    groups = defaultdict(list)
    shas = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t in rows]
    for (i, _), s in zip(rows, shas):
        groups[s].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return [(i, least(groups[s]), len(groups[s]), s) for (i, _), s in zip(rows, shas)]


def brute_fingerprint(text):
    import xxhash

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=3):
    """Root of each place: the first place that links reach."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]
