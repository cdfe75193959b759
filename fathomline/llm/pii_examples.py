"""The small labelled table that the personal-data tagger is trained from."""

from __future__ import annotations

import random

Row = tuple[str, list[tuple[str, int, int]]]

# Lines with slots, written for this table.
LINES = """
Contact us at {email} for details.|Write to {email}, please.|{email} wrote this.|Mail: {email}|reach me: {email} or {phone}
Call {phone} today.|Phone {phone}.|Tel. {phone} (office)|the and {phone} of the|My number is {phone}, ask for Ana.|{phone} is the one
Pay with card {card}.|Card number {card} was charged.|the of {card} and in|{card} expires soon.|card: {card}, name: Lee
Host {ip} is down.|ping {ip}|the server {ip}, port {small}|in {ip} the of|from {ip} to {ip}
api_key = {secret}|token: {secret}|password {secret} was leaked|"key": {secret}|secret={secret}|the {secret} of
Version {version} was released.|Licensed under CC BY-NC {decimal}.|License, Version {decimal}.|In {year} there were {small} of them.|It costs {decimal} euros.
Order {number} was shipped on {date}.|see page {small}, line {small}|at {time} on {date}|{small} of {small} items|id {number} and {number}
the total is {decimal} percent|chapter {small}.{small} says|{year}-{year} report|room {small}, floor {small}|@ home with {small} friends|price @ {decimal}
score {small}-{small} at {time}|number {failed} is no card|{failed} rows were read|the {failed} and the|born {date}, moved in {year}|{version} and {version}
"""
WORDS = "the of and to in river stone letter mountain house garden window morning people water light paper street".split()


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _fill(kind: str, rng: random.Random) -> str:
    word = lambda: rng.choice(WORDS)
    if kind == "email":
        return rng.choice(["{a}.{n}@{b}.example.com", "{a}{n}@{b}.org", "{a}@{b}.net", "{a}_{b}@mail{n}.example.org", "{a}@{b}", "{a} @ {b}.com"]).format(
            a=word(), b=word(), n=rng.randint(1, 99))
    if kind == "phone":
        return rng.choice(["+1 ({}) {}-{}", "({}) {}-{}", "+44 {} {} {}", "{}-{}-{}", "+49-{}-{}{}", "+1 {}.{}.{}"]).format(_digits(rng, 3), _digits(rng, 3), _digits(rng, 4))
    if kind in ("card", "failed"):
        while True:
            d = _digits(rng, 16)
            if luhn(d) == (kind == "card"):
                return d if kind == "failed" or rng.random() < 0.6 else rng.choice(" -").join(d[i:i + 4] for i in range(0, 16, 4))
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "secret":
        chars = rng.choice(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcXYZ0123456789"])
        return "".join(rng.choice(chars) for _ in range(rng.randint(24, 44))) + "7f"
    if kind == "version":
        return rng.choice(["{}.{}.{}", "v{}.{}", "{}.{}"]).format(*(rng.randint(0, 12) for _ in range(3)))
    if kind == "decimal":
        return f"{rng.randint(0, 99)}.{rng.randint(0, 9)}"
    if kind == "date":
        return rng.choice(["{}-{:02d}-{:02d}", "{}/{}/{}"]).format(rng.randint(1950, 2026), rng.randint(1, 12), rng.randint(1, 28))
    if kind == "time":
        return f"{rng.randint(0, 23)}:{rng.randint(10, 59)}"
    return str(rng.randint(1950, 2026) if kind == "year" else rng.randint(1, 200) if kind == "small" else rng.randint(1000, 99_999_999))


def labelled_rows(copies: int = 8, seed: int = 5) -> list[Row]:
    """(text, [(kind, start, end)]): every line ``copies`` times, with other values and words around it."""
    rng, out = random.Random(seed), []
    kept = ("email", "ip", "card", "phone", "secret")
    for line in LINES.strip().replace("\n", "|").split("|"):
        for _ in range(copies):
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 4)))
            text, spans, at = text + " " * bool(text), [], 0
            while (a := line.find("{", at)) >= 0:
                b = line.index("}", a)
                value = _fill(line[a + 1:b], rng)
                text += line[at:a]
                if line[a + 1:b] in kept:
                    spans.append((line[a + 1:b], len(text), len(text) + len(value)))
                text, at = text + value, b + 1
            out.append((text + line[at:], spans))
    return out
