"""Small tables, and line dedup by comparing all lines."""

import random
from collections import Counter

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words_of(language, rng):
    syllables = {"en": ["the", "ing", "ou", "th", "ea"], "de": ["sch", "ein", "ung", "ä", "keit"], "fr": ["eau", "é", "les", "tre", "oi"]}[language]
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(120)]


def documents(seed, n=90):
    """(doc_id, text, lang, source): lines of three invented languages, with copies, near copies, short lines, nulls, a long line and a hot source."""
    rng = random.Random(seed)
    vocabulary = {k: words_of(k, rng) for k in ("en", "de", "fr")}
    rows, pool = [], {k: [] for k in vocabulary}
    for i in range(n):
        lang = rng.choice(sorted(vocabulary))
        lines = []
        for _ in range(rng.randint(1, 7)):
            roll = rng.random()
            if pool[lang] and roll < 0.2:
                line = rng.choice(pool[lang])
            elif pool[lang] and roll < 0.5:
                w = rng.choice(pool[lang]).split(" ")
                for _ in range(max(1, len(w) // rng.choice((8, 12, 30)))):
                    w[rng.randrange(len(w))] = rng.choice(vocabulary[lang]) + rng.choice(LETTERS)
                line = " ".join(w)
            elif roll < 0.6:
                line = rng.choice(["All rights reserved.", "Read more", "", "x", "12", "— 3 —"])
            else:
                line = " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(5, 40)))
            pool[lang].append(line)
            lines.append(line)
        source = "hot" if rng.random() < 0.4 else rng.choice(["b", "c", None])
        rows.append((i, "\n".join(lines), lang if rng.random() < 0.9 else None, source))
    long = " ".join(rng.choice(vocabulary["de"]) for _ in range(1500))
    return [*rows, (n, long, "de", "c"), (n + 1, "a passage before it " + long, "de", "hot"), (n + 2, None, "en", "b"), (n + 3, "", None, None), (n + 4, " \n\t\n", "fr", None), (n + 5, "123 !?", "fr", "b")]


def write(spark, folder, rows):
    data = [(i, t, lang, source, len(t) if t is not None else None, "clash", 7) for i, t, lang, source in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, node string, band long").repartition(3).write.parquet(str(folder / "documents.parquet"))


def distance(x, y, most):
    """Levenshtein distance row by row; most + 1 if it is larger."""
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        if min(row) > most:
            return most + 1
    return row[-1]


def normal(line):
    out = []
    for c in line:
        out.append(c if ord(c) > 127 else c.lower() if c.isalpha() else "0" if c.isdigit() else " ")
    return " ".join("".join(out).split(" ")).split()


def lines_left(rows, similarity=0.8):
    """{doc_id: text without its late lines}: lines of five words by all pairs of normal forms, shorter ones if they are equal."""
    at = [(i, k, x) for i, t in sorted(rows) if t is not None for k, x in enumerate(t.split("\n"))]
    name, whole = [], {}
    for i, k, x in at:
        w = normal(x)
        if len(w) >= 5:
            name.append(("long", " ".join(w)))
        elif len("".join(w)) > 1:
            name.append(("short", x.strip(" \t\r\x0b\x0c")))
        else:
            name.append(("own", i, k))
        whole.setdefault(name[-1], name[-1])
    long = sorted((n[1] for n in whole if n[0] == "long"), key=len)

    def find(n):
        while whole[n] != n:
            n = whole[n]
        return n

    for i, x in enumerate(long):
        for y in long[i + 1 :]:
            most = int((1 - similarity) * len(y) + 1e-9)
            if len(y) - len(x) > most:
                break
            a, b = find(("long", x)), find(("long", y))
            if a != b and (y.endswith(x) or distance(x, y, most) <= most):
                whole[a] = b
    seen, gone = set(), set()
    for (i, k, _), n in zip(at, name, strict=True):
        root = find(n)
        if root in seen:
            gone.add((i, k))
        seen.add(root)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def removals(rows):
    """{(doc_id, n-th copy of a line, line)} of the lines that (doc_id, text, text left) has lost."""
    out = set()
    for i, before, after in rows:
        left = Counter((after or "").split("\n")) if after is not None else Counter()
        for line, n in Counter((before or "").split("\n")).items():
            out |= {(i, k, line) for k in range(left[line], n) if before is not None and line}
    return out
