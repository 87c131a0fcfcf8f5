"""Rows with every awkward case."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=80):
    """Words that hardly repeat as shingles."""
    return " ".join(WORDS[(seed * 7 + i * i + i // 3 * seed) % len(WORDS)] + str((seed * 31 + i) % 97) for i in range(n))


ODD = [
    (1, prose(1), "en", "a"),
    (2, prose(1), "en", "a"),
    (3, None, "en", "a"),
    (4, "", "de", "b"),
    (5, " \n\t ", "de", None),
    (6, "one two", None, "b"),
    (7, "one two", "en", "b"),
    (8, prose(2) + "\n" + prose(3), "en", "a"),
    (8, prose(2) + "\n" + prose(3), "en", "a"),
    (9, "x" * 70_000 + " " + prose(4, 3000), "fr", "c"),
    (None, prose(1), "en", "a"),
    (None, None, None, None),
    (10, "🙂 café \x00 naïve \r\n" * 5 + "#*$%&|<>", "fr", "c"),
    (11, prose(1).replace("alpha", "omega", 1), "en", "a"),
]
CLASHES = ["n", "class", "band", "key", "sig", "size", "shard", "node", "score", "quality", "line", "h1", "place", "root", "row", "count", "label", "group"]
