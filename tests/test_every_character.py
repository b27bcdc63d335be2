"""Codes beside, and with a letter replaced by, each character of the basic plane, against SQL."""

from __future__ import annotations

import duckdb
import pandas as pd

from loamfield import queries

FORMS = ("{0}the words die{0} _ les{0}{0}", "_the{0} _die {0}les {0}ords", "words {0}ights licen{0}e", "words right{0} {0}icense 7")


def test_coded_segments(spark, tmp_path):
    points = [p for p in range(0x10000) if not 0xD800 <= p < 0xE000]
    rows = pd.DataFrame([(4 * p + i, form.format(chr(p)), "en", "src0", p) for p in points for i, form in enumerate(FORMS)], columns=["doc_id", "text", "lang", "source", "n_chars"])
    rows.to_parquet(f"{tmp_path}/documents.parquet")
    queries.queries()["coded_segments"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/got")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE TABLE want AS {queries.oracle_sql()['coded_segments']}")
    con.execute(f"CREATE TABLE got AS SELECT std_id, code_key, start_char, end_char, text FROM '{tmp_path}/got/*.parquet'")
    want, got = "SELECT std_id, code_key, start_char, end_char, text FROM want", "SELECT * FROM got"
    assert con.execute("SELECT count(*) FROM want").fetchone()[0] > len(rows)
    assert con.execute(f"({want} EXCEPT ALL {got}) UNION ALL ({got} EXCEPT ALL {want}) LIMIT 5").fetchall() == []
