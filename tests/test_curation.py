"""People in messages."""

import duckdb

from heddle.operators import curation

SQL = r"SELECT session_id, name, least(count(*), 5)::INTEGER AS confidence FROM (SELECT session_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]+ [A-Z][a-z]+\b')) AS name FROM m) GROUP BY ALL"


def test_names_end_at_ascii_word_characters_as_in_sql(spark):
    """Letters beyond ASCII, marks and joiners on either side are no part of a name; ASCII letters, digits and underscores are."""
    around = ["", " ", "\n", ".", "ä", "ü", "é", "ß", "ó", "Я", "中", "a\u0301", "\u0301", "\u200d", "\u00a0", "😀", "x", "X", "7", "٧", "_", "-", "\x00"]
    texts = [f"{a}Anna Smith{b}" for a in around for b in around] + ["Anna Smith Bob Jonesä Cy Day", "Anna Smithä Bob Jones", "Anna SmithBob Jones", "Änna Smith", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "Anna Smithä")] + [(9_999, "Anna Smithé ")] * 7
    got = curation.people(spark.createDataFrame(rows, "session_id long, text string")).collect()
    c = duckdb.connect()
    c.execute("CREATE TABLE m (session_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO m VALUES (?, ?)", rows)
    want = c.execute(SQL).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert (9_999, "Anna Smith", 5) in want and (None, "Anna Smith", 1) in want
