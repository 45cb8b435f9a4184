"""Labelled tokens that the automata of secrets.py are inferred from: credentials in public formats and ordinary tokens, drawn by rule.

A format is a list of pieces: fixed text, or (alphabet, fewest, most) characters drawn evenly. How many tokens of
each are drawn, and the seed, are parameters; with the same ones the same tokens come out.
"""

from __future__ import annotations

import random

EACH, SEED = 96, 11
UPPER, DIGITS, HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
ALNUM = UPPER + UPPER.lower() + DIGITS
SAFE = ALNUM + "-_"

#: Public formats of credentials.
FORMATS = {
    "cloud access key": ["AKIA", (UPPER + DIGITS, 16, 16)],
    "cloud temporary key": ["ASIA", (UPPER + DIGITS, 16, 16)],
    "forge personal token": ["ghp_", (ALNUM, 36, 36)],
    "forge server token": ["ghs_", (ALNUM, 36, 36)],
    "lab personal token": ["glpat-", (SAFE, 20, 20)],
    "payment live key": ["sk_live_", (ALNUM, 24, 32)],
    "map key": ["AIza", (SAFE, 35, 35)],
    "package token": ["npm_", (ALNUM, 36, 36)],
    "mail key": ["SG.", (SAFE, 22, 22), ".", (SAFE, 43, 43)],
    "chat bot token": ["xoxb-", (DIGITS, 11, 12), "-", (DIGITS, 12, 12), "-", (ALNUM, 24, 24)],
    "web token": ["eyJ", (SAFE, 15, 60), ".eyJ", (SAFE, 40, 130), ".", (SAFE, 40, 90)],
    "signing secret": ["whsec_", (ALNUM, 32, 32)],
}
SYLLABLES = "al an ar able com con de ed en er es ing le ment on or ou per pro re st te the ti tion".split()


def drawn(draw: random.Random, pieces: list) -> str:
    return "".join(p if isinstance(p, str) else "".join(draw.choices(p[0], k=draw.randint(p[1], p[2]))) for p in pieces)


def _word(draw: random.Random, low: int = 1, high: int = 4) -> str:
    return "".join(draw.choices(SYLLABLES, k=draw.randint(low, high)))


def _hex(draw: random.Random, n: int) -> str:
    return "".join(draw.choices(HEX, k=n))


#: Ordinary tokens by kind, each a rule.
KINDS = {
    "word": lambda d: _word(d, 6, 10),
    "hyphens": lambda d: "-".join(_word(d) for _ in range(d.randint(3, 6))),
    "underscores": lambda d: "_".join(_word(d) for _ in range(d.randint(3, 6))),
    "path": lambda d: "/".join(_word(d) for _ in range(d.randint(3, 5))) + d.choice(["/a.html", "/index", ".png", "/b.png", ".tar.gz"]),
    "host": lambda d: f"{d.choice(['web', 'mail', 'cdn'])}{d.randint(1, 99)}." + ".".join(_word(d) for _ in range(2)) + d.choice([".example.com", ".org"]),
    "camel": lambda d: "".join(_word(d, 1, 3).capitalize() for _ in range(d.randint(4, 7))),
    "constant": lambda d: "_".join(_word(d, 1, 2).upper() for _ in range(d.randint(3, 5))) + "_MAX",
    "number": lambda d: "".join(d.choices(DIGITS, k=d.randint(16, 24))),
    "date": lambda d: f"20{d.randint(10, 39)}-{d.randint(1, 12):02}-{d.randint(1, 28):02}/{_word(d, 1, 2)}-{d.randint(0, 999)}",
    "rule": lambda d: d.choice(".=-_") * d.randint(20, 40),
    "uuid": lambda d: "-".join(_hex(d, n) for n in (8, 4, 4, 4, 12)),
    "build": lambda d: f"{_word(d, 1, 2)}-{d.randint(0, 9)}.{d.randint(0, 30)}.{d.randint(0, 99)}-{d.choice(['rc', 'beta', 'build', 'snapshot'])}.{d.randint(1, 9999)}+g{_hex(d, d.randint(7, 10))}",
    "digest in a file name": lambda d: f"{_word(d, 1, 2)}{d.choice('.-')}{_hex(d, d.choice([8, 12, 20, 32]))}.{d.choice(['js', 'min.js', 'css', 'chunk.js', 'map'])}",
    "base number": lambda d: f"{_word(d, 1, 2)}-{''.join(d.choices(DIGITS, k=d.randint(6, 10)))}-{''.join(d.choices(DIGITS, k=d.randint(3, 6)))}-{_word(d, 1, 2)}",
}


def credentials(each: int = EACH, seed: int = SEED) -> dict[str, list[str]]:
    draw = random.Random(seed)
    return {name: [drawn(draw, pieces) for _ in range(each)] for name, pieces in FORMATS.items()}


def ordinary(each: int = EACH, seed: int = SEED) -> dict[str, list[str]]:
    draw = random.Random(seed + 1)
    return {name: [make(draw) for _ in range(each)] for name, make in KINDS.items()}
