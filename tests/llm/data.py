"""Small awkward documents: nulls, empty and long texts, copies, repeated rows, clashing column names."""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi tu ren sha bo dir ven po el ast".split()
# Columns named like the operators' own.
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, size string, fp string, key string, _slot string"


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def texts() -> dict[int, str | None]:
    base = words(1, 120)
    changed = [*base[:60], "other", *base[61:]]
    passage = words(2, 60)
    found: dict[int, str | None] = {
        0: " ".join(base),
        1: None,
        2: "",
        3: " \t\n ",
        4: " ".join(base),
        5: " ".join(changed),
        6: " ".join([*words(3, 30), *passage, *words(4, 30)]),
        7: "\n".join([*words(5, 40), *passage, *words(6, 10)]),
        8: "one",
        9: "two words",
        10: " ".join(["same"] * 200),
        11: " ".join(["same"] * 150),
        12: " ".join(words(7, 30_000)),
        13: "Été ŒUVRE niño Straße £5 — don't it's 'tis ²½ 東京 x\x1cy <|endoftext|> " + " ".join(words(8, 20)),
        14: " ".join(words(9, 12)),
        15: " ".join(words(9, 13)),
        16: " ".join(words(9, 14)),
    }
    for i in range(20, 40):
        found[i] = " ".join(words(100 + i, 50 + i))
    for i in range(40, 60):
        found[i] = found[0] if i % 2 else found[5]
    return found


def rows() -> list[tuple]:
    out = []
    for i, text in texts().items():
        source = None if i % 7 == 0 else ("big" if i % 3 == 0 else f"s{i % 5}")
        out.append((i, text, None if i % 4 else "en", source, len(text or ""), "r", "s", "f", "k", "t"))
    return out


def documents(spark, extra=()):
    return spark.createDataFrame([*rows(), *extra], COLUMNS).repartition(5)


def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


WITHOUT_ID = (None, "a row without an id " + " ".join(words(1, 40)), "en", "s1", 3, "r", "s", "f", "k", "t")
