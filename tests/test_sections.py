"""doc_section over documents that have headings, fences and carriage returns of their own."""

import duckdb
import pytest

from quillmesh.plans.registry import ORACLES, QUERIES

TEXTS = [
    "plain\nlines",
    "with\r\nreturns\r\r\nand \r inside\r",
    "above\n## Two\nbelow\n# Next\nnot here",
    "a\n```\n# fenced\n~~~\n````\nb\n   # ends\nc",
    "a\n~~~~ x\n```\n~~~\n# fenced\n~~~~~\n#no\n####### no\n # \nc",
    "left open\n```\n# fenced",
    "",
    "# first",
    None,
    " \x0b~~~\n# fenced\n\x1c~~~\n#\n　\x85# ends",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("sections")
    con = duckdb.connect()
    con.sql("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO d VALUES (?, ?, 'en', 'src1', 1)", [[k, t] for k, t in enumerate(TEXTS)])
    con.sql("INSERT INTO d VALUES (0, 'of one path', 'en', 'src1', 1), (NULL, 'no id', 'en', 'src1', 1)")
    con.sql(f"COPY d TO '{out}/documents.parquet'")
    return str(out)


def test_doc_section_reads_every_document(spark, folder):
    con = duckdb.connect()
    tables = "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = sorted(map(tuple, QUERIES["doc_section"](spark, folder).collect()))
    assert found == sorted(con.sql(ORACLES["doc_section"]).fetchall())
    end = lambda k: f"```\n# no heading\n```\n### Three [in](x/{k}.md) it\nend\n"
    want = {
        0: "plain\nlines\n" + end(0), 1: "with\nreturns\r\nand \r inside\n" + end(1), 2: "above\n## Two\nbelow\n", 3: "a\n```\n# fenced\n~~~\n````\nb\n", 4: "a\n~~~~ x\n```\n~~~\n# fenced\n~~~~~\n#no\n####### no\n",
        5: "left open\n```\n# fenced\n```\n", 6: "\n" + end(6), 7: "", 9: " \x0b~~~\n# fenced\n\x1c~~~\n#\n",
    }
    rows = [(f"src1/en/{k}.txt", "# One\n" + x) for k, x in want.items()] + [("src1/en/0.txt", "# One\nof one path\n" + end(0))]
    assert found == sorted(rows)
