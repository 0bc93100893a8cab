#: Rows that every operator must take: null ids and texts, empty and very long texts, repeats.
ODD = [(None, None), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "x" * 50_000), (5, "word " * 20_000), (6, "\n\n \t\r\n"), (None, "a b c"), (7, "É ñ 😀 İ\x00 z"), (8, "word " * 20_000)]
