"""Small tables with every awkward case, and plain Python counterparts to hold the operators against."""
import random

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, id long, h string, hash string, size string, "
           "row string, s string, bucket string, content string, content_hash string, fp string, packing string, tokens string, "
           "core string, label string, quality string, kept string, position string, words string, host string")
EXTRAS = COLUMNS.count(",") + 1 - 5


def docs(spark, pairs, source="src0"):
    """Rows of ``documents`` from (doc_id, text) or (doc_id, text, source), with extra columns of clashing names."""
    rows = []
    for p in pairs:
        d, t, s = (*p, source)[:3]
        rows.append((d, t, "en", s, len(t or ""), *[d if i == 0 else f"x{i}" for i in range(EXTRAS)]))
    return spark.createDataFrame(rows, COLUMNS)


def sentences(seed, n, words=40):
    rng = random.Random(seed)
    syllables = ["the", "of", "and", "er", "ing", "tion", "an", "re", "on", "is", "é", "ß"]
    return [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words)) for _ in range(n)]


def awkward(seed=1):
    """Nulls, empty and white texts, repeated rows and ids, copies, ties and one long text."""
    s = sentences(seed, 12)
    long = " ".join(sentences(seed + 1, 120, 60))
    return [(0, s[0]), (1, s[0]), (2, s[0].upper()), (3, s[1]), (3, s[1]), (4, None), (5, ""), (6, " \t\n "), (7, long),
            (8, long + " end"), (9, s[2] + "\n" + s[2]), (10, "a"), (11, "a b c"), (12, "Ä ä"), (None, s[3]), (None, s[3]),
            (13, s[4] + " " + s[5]), (14, s[5] + " " + s[4]), (15, "x" * 900), (16, "x" * 399), (17, s[6], None), (18, s[7], None),
            (19, s[8], "src1"), (20, s[9], "src1"), (21, s[10], "Ω"), (22, "1 | 2 | 3 ### $$$")]
