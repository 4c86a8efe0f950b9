"""Sequences that powers of one base modulo 2 ** 64 cannot tell apart."""


def thue_morse(n: int, a: str, b: str) -> tuple[list[str], list[str]]:
    """2 ** n symbols and their complement."""
    bits = [0]
    for _ in range(n):
        bits += [1 - x for x in bits]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def thue_morse_words() -> tuple[str, str]:
    """Two words of 1,024 letters."""
    x, y = thue_morse(10, "a", "b")
    return "".join(x), "".join(y)
