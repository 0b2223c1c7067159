"""Fixes wait for the marks of their patterns."""

from __future__ import annotations

from scanweave.operators import fixes as fx


def test_injection_fixes_wait_for_their_marks():
    sql = fx.strategies("t")
    assert sql["sql-injection-template"].startswith("CASE WHEN contains(t, '(') AND contains(t, '`') AND contains(t, ")
    assert sql["sql-injection-concat"].startswith("CASE WHEN contains(t, '(') AND contains(t, '\"') AND contains(t, '+') AND ")


def test_a_line_goes_to_the_fixes_whose_marks_it_has(spark):
    texts = ["db.query(`SELECT ${x}`)", 'db.query("a = \'" + x + "\'")', "PASSWORD: 'x'", "const Pwd = 'y'", "secret = 'z'", "Api-Key: 'k'", "apikey = 'k'",
             "console.log(x)", "see http://a.b", "el.innerHTML = x", "localStorage.setItem(k, v)", "fetch('/x')", "axios.get('/x')",
             "http.get('/x')", "logger.info('x', patient)", "Logger.info(patientRow)", "cookie: { a: 1 }", "res.cookie('a', b)",
             "fs.writeFile('my-backup.sql'", "writeFile('backup', x)", "const BackUp = 'x.sql'", "plain", "", None]
    lines = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    every = lines.crossJoin(spark.createDataFrame([(k,) for k in fx.MARKS], "fix_type string"))
    want = {tuple(r) for r in fx.fix_cases(every).filter("fixed IS NOT NULL").select("n", "fix_type", "fixed").collect()}
    some = fx.possible_fixes(lines, list(fx.MARKS))
    assert {tuple(r) for r in fx.fix_cases(some).filter("fixed IS NOT NULL").select("n", "fix_type", "fixed").collect()} == want
    assert {k for _, k, _ in want} == set(fx.MARKS) == set(fx.strategies("t")) and some.count() < every.count() / 4
