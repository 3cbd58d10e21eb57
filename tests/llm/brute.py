"""Plain forms of the operators' rules, for small tables."""

import collections
import itertools
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows with a null in each column, empty and blank texts, ties, repeated rows and a text of many words.
ROWS = [
    (0, "alpha beta gamma delta epsilon zeta\nshared line of ten words that stands in more than one text", "en", "a", 5), (1, None, None, None, None), (2, "", "de", "", 0), (3, " \t\n ", "fr", "b", 4),
    (4, "x y", "en", "a", 3), (4, "x y", "en", "a", 3), (None, "x y", "en", None, 3), (5, "shared line of ten words that stands in more than one text\nown words", "en", "b", 9),
    (6, "alpha beta gamma delta epsilon zeta\nshared line of ten words that stands in more than one text", "es", "c", 5), (7, "long " * 30_000 + "end", "en", "c", 150_003), (8, "ÄÖ ünï 日本語 \U0001f600 <|endoftext|> </s>\x1c\x85", "en", "b", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def held_out(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == 0


def near_duplicates(rows):
    """{(id, shingles, component)} as a sorted list; null ids are the least."""
    key = lambda i: (i is not None, i)
    sets = collections.defaultdict(set)
    for i, text in rows:
        w = WORD.findall(lower(text))
        sets[i] |= {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)), key=key)
            parent[y] = x
    return sorted(((i, len(sets[i]), root(i)) for i, _ in rows), key=str)


def dedup_lines(rows, least):
    """{row position: kept text}: a line goes if it is in a run of ``least`` words that stands earlier; rows in order, distinct ids."""
    docs = [(i, [(p, x, len(WORD.findall(x))) for p, x in enumerate((t or "").split("\n")) if WORD.search(x)]) for i, t in rows]
    seen, gone = {}, collections.defaultdict(set)
    runs = []
    for i, lines in docs:
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += lines[b][2]
                if words >= least:
                    runs.append((tuple(x[1] for x in lines[a : b + 1]), i, lines[a][0], lines[b][0]))
    for run, i, first, last in runs:
        if run in seen:
            gone[i] |= set(range(first, last + 1))
        else:
            seen[run] = i
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone[i]) for i, t in rows}
