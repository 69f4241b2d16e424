"""Helpers shared by the tests of the training-data operators."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Documents with nulls, empty, very long and repeated texts, and text of every awkward kind."""
    long_text = " ".join(f"word{k % 977} and" for k in range(30_000))
    plain = " ".join(f"the of and plain{k} to in" for k in range(40))
    texts = [
        None, "", " ", "\n\t \x0b", "one", "a b c d", "a b c d e", "A B C D E", plain, plain, plain.upper(), plain + " tail words", long_text, "x" * 50_000, "1 " * 20_000, "dup line\n" * 60, "é " * 80, "日本語 テキスト " * 30,
        "mail me at a.b+c@mail.example.com, or call +1 (456) 555-2186 now", "card 4111 1111 1111 1111 ip 10.0.0.255 and 300.1.1.1", "a@b.c_d@e.f.g x@y 1.2.3.4.5.6.7.8 4111-1111-1111-1112", "<|endoftext|> it's  fine\r\n\r\n", "Released under the MIT License.", " x 56",
    ]
    return [(k, t, [None, "en", "fr", "xx"][k % 4], None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)] + [(8, plain, "en", "s1", len(plain)), (None, "no id here", None, None, None)]


def rows(records):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in records)


def equal(found, expected):
    """A DataFrame against a DuckDB result, by name of column."""
    names = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(tuple(r[c] for c in names) for r in found.collect()) == rows(expected.fetchall())
