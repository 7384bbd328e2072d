import pytest


@pytest.fixture(scope="module")
def odd_texts():
    """Null, empty, blank, repeated and very long texts."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    long = " ".join(words[(i * i) % 10] + str(i % 97) for i in range(30_000)) + "."
    return [None, "", " \n\t ", "One line.", "One line.", long, long.replace("alpha0", "Alpha0", 1), "x" * 50_000,
            "Été \U0001f600 naïve İstanbul. Ende!"]
