SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, rep string, mix_size int"
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def prose(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 99991}" for i in range(n))


ROWS = [
    (1, prose(1, 300), "en", "a", 0, "x", 1),
    (2, prose(1, 300), "en", "b", 0, "x", 1),  # copy of 1
    (3, prose(1, 299) + " other", "en", "b", 0, "x", 1),  # near 1
    (4, prose(4, 40) + " " + PASSAGE + " " + prose(5, 30), "en", "c", 0, None, None),
    (5, prose(6, 80) + " " + PASSAGE + "\n" + prose(7, 10), "en", None, 0, "x", 1),
    (6, None, None, "a", None, None, None),
    (7, "", "en", "a", 0, "x", 1),
    (8, "  \n\n ", "en", "a", 0, "x", 1),
    (9, "<|endoftext|> aé中\U0001f44d  x\n\n\ty", "en", "b", 0, "x", 1),
    (10, "the " * 20_000, "en", "c", 0, "x", 1),
    (11, prose(11, 9_000), "en", "c", 0, "x", 1),
    (11, prose(11, 9_000), "en", "c", 0, "x", 1),  # a repeated row
]
