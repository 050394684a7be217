"""Where the given tables are, and rows that every operator must survive."""

SF = "/root/testdata/sf0.001"
#: Rows to survive: nulls, empty and blank texts, repeated rows and ids, ties, a very long text.
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
ROUGH = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 1),
    (2, "ONE two three four five six seven eight nine ten eleven twelve", "en", "a", None),
    (3, None, None, None, None), (4, "", "en", "", 0), (5, " \n\t ", "en", "b", 4),
    (6, "solo", "en", "b", 4), (6, "solo", "en", "b", 4), (7, "Solo", None, "b", 4),
    (None, "one two three four five six seven eight nine ten eleven twelve", "en", None, 1),
    (None, None, None, None, None), (8, LONG, "en", "c", len(LONG)), (9, LONG + " end", "en", "c", 1),
    (10, "näive ☃ Ünïcode 😀 text\nnäive ☃ Ünïcode 😀 text\n\nlast", "de", "é", 3),
]
ROUGH_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
