"""Secrets longer than 128 characters and of lower-case letters and digits alone."""

import random
import string

import pytest

from skein.llm import secrets

IDENT, END = "ASIAX7EXAMPLE42Q", "https://store.example.org/bucket"


@pytest.mark.parametrize("letters,size", [
    (string.ascii_letters + string.digits + "+/", 40), (string.ascii_letters + string.digits + "+/", 129),
    (string.ascii_letters + string.digits + "-_", 5_000), (string.ascii_lowercase + string.digits, 20), (string.ascii_lowercase + string.digits, 300),
])
def test_secret_beside_an_identifier(letters, size):
    key = "z7" + "".join(random.Random(size).choices(letters, k=size - 2))
    assert secrets.find(f"{IDENT} at {END} with {key}") == [
        ("weak_id", 0, 16), ("endpoint", 20, 20 + len(END)), ("weak_secret", 26 + len(END), 26 + len(END) + size),
    ]
    assert secrets.find(f"{key} at {END}") == []
    assert secrets.find(f"{IDENT} by 2024/some-lower-case-title-of-a-page") == []


@pytest.mark.parametrize("size", [12, 24, 34, 64, 500])
def test_identifier_of_any_length_beside_a_secret(size):
    name = "Z7" + "".join(random.Random(size).choices(string.ascii_uppercase + string.digits, k=size - 2))
    key = "z7" + "".join(random.Random(size).choices(string.ascii_letters + string.digits, k=38))
    assert secrets.find(f"{name} with {key}") == [("weak_id", 0, size), ("weak_secret", size + 6, size + 46)]
    assert secrets.find(f"{name} alone") == [] == secrets.find(f"{key} alone")


def test_links_against_all_pairs():
    """Weak parts of random texts: each one just if its complement lies within the scope."""
    rng = random.Random(11)
    parts = {
        "weak_id": lambda: "ASIA7" + "".join(rng.choices(string.ascii_uppercase, k=11)), "weak_secret": lambda: "z7Q" + "".join(rng.choices(string.ascii_letters, k=30)),
        "endpoint": lambda: "https://a.example/" + "".join(rng.choices("bcd", k=4)), "access": lambda: "AKIA" + "Q" * 16, None: lambda: "word",
    }
    linked = 0
    for _ in range(300):
        text, made = "", []
        for kind in rng.choices(list(parts), k=rng.randint(2, 9)):
            piece = parts[kind]()
            made.append((kind, len(text), len(text) + len(piece)))
            text += piece + " " * rng.choice([1, 30, 150, 250])

        def meets(x, *kinds):
            return [y for y in made if y[0] in kinds and y is not x and max(y[1] - x[2], x[1] - y[2]) <= secrets.SCOPE]

        ids, keys = ("weak_id", "access"), ("weak_secret",)
        want = [x for x in made if x[0] == "access"]
        for x in made:
            if x[0] == "weak_id" and meets(x, *keys) or x[0] == "weak_secret" and meets(x, *ids):
                want.append(x)
            if x[0] == "endpoint" and any(meets(y, *keys) for y in meets(x, *ids)) and any(meets(y, *ids) for y in meets(x, *keys)):
                want.append(x)
        got = secrets.find(text)
        assert got == sorted(want, key=lambda x: (x[1], secrets.KINDS.index(x[0])))
        linked += sum(k == "endpoint" for k, _, _ in got)
    assert linked
