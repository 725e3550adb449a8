"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, ties and clashing columns."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, h string, sig string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("th", "er", "on", "é", "an", "st", "ing")) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def texts(seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    base = [sentence(rng, 60) for _ in range(6)]
    lines = [sentence(rng, rng.randint(1, 25)) for _ in range(30)]
    out: list[str | None] = [None, "", "   \n\t ", "one", "one two three", "Ünïcode 　 x y 😀 </s>[INST]\\"]
    out += base + [base[0], base[0].upper(), base[1] + " " + sentence(rng, 8), " ".join(base[2].split()[:-3]), base[3].replace("er", "ER", 2)]
    out += ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8))) for _ in range(25)]
    out += ["word " * 4000 + "end", "a" * 9000, "\n".join(lines), "\n".join(lines[::-1])]
    swapped = lines[0].split(" ")
    out += [" ".join(swapped[:3] + ["other"] + swapped[4:]), " ".join(swapped[:5] + swapped[6:])]
    return out


def rows(seed: int = 3) -> list[tuple]:
    """Documents with ids in no order, a null id, repeated rows, one source with most rows, a null source, and columns named like inner ones."""
    found = [((i * 7) % 101, t, "en" if i % 3 else None, "hot" if i % 2 else (f"s{i % 5}" if i % 7 else None), len(t or ""), "x", "y", None) for i, t in enumerate(texts(seed))]
    found += [found[8], found[8], (None, found[9][1], None, None, None, None, None, None), (None, "only here once", None, "hot", 3, "a", "b", "c")]
    return found
