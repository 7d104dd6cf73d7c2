import random

import duckdb

from stripweave.llm import licenses as L
from tests.harness import compare
from tests.llm.nasty import awkward, documents

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files (the \"Software\"),\n"
       "to deal in the Software without restriction")
BSD = "Redistribution and use in source and\nbinary forms, with or without\nmodification, are permitted provided that"


def test_wrapped_notices_and_scattered_words(spark):
    scattered = " ".join(["all"] + ["word"] * 40 + ["rights"] + ["word"] * 40 + ["reserved"])
    apart = "all\n" + "word\n" * 40 + "rights\n" + "word\n" * 40 + "reserved"
    long = " ".join(["word"] * 5000 + ["released under the mit license"] + ["word"] * 5000)
    texts = [MIT, "x y z\n" * 50 + "// " + MIT.replace("\n", "\n// "), BSD, scattered, apart, long, "Released under the MIT License", "all rights\nreserved"]
    rows = {r["doc_id"]: r for r in L.license_report(documents(spark, texts)).collect()}
    assert [rows[i]["labels"] for i in range(8)] == ["mit", "mit", "bsd", "", "", "mit", "mit", "reserved"]
    assert [rows[i]["score"] for i in range(8)] == [1, 1, 1, 0, 0, 1, 1, 1]
    assert [rows[i]["n_blocks"] for i in range(8)] == [1, 1, 1, 0, 0, 1, 1, 1]


def test_runs_are_every_window():
    random.seed(9)
    templates = [("one", "a b c d e"), ("two", "c d e f g h i j"), ("three", "k"), ("four", "a b k l m n")]
    for percent in (50, 75, 100):
        index = L.Templates(templates, {}, percent)
        for _ in range(150):
            words = [random.choice("abcdefghijklmnopqrstuv").encode() for _ in range(random.randint(0, 80))]
            passed = {k for k, _ in index.matches(frozenset(words) & index.words)}
            for t, s in enumerate(index.sets):
                size, hit, best = index.window[t], set(), 0
                for i in range(len(words)):
                    found = [j for j in range(i, min(len(words), i + size)) if words[j] in s]
                    n = len({words[j] for j in found})
                    if 100 * n >= percent * len(s):
                        best = max(best, n / len(s))
                        hit |= set(range(found[0], found[-1] + 1))
                runs = index.runs(t, words)
                assert {p for a, b, _ in runs for p in range(a, b + 1)} == hit and max((c for *_, c in runs), default=0) == best
                assert bool(runs) <= (t in passed)


def test_sql_takes_windows_too(spark):
    scattered = " ".join(["all"] + ["word"] * 40 + ["rights"] + ["word"] * 40 + ["reserved"])
    twice = MIT + "\n" + "x " * 80 + "\n" + MIT.replace("\n", " ") + "\nreleased under\nthe mit license released under the mit license"
    docs = awkward(spark, [(40, MIT), (41, BSD), (42, scattered), (43, twice), (44, "all\nrights all rights\nreserved rights"), (45, "released under the mit license\nunder the mit license released")])
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    assert compare(L.license_report(docs), con, L.REPORT_SQL) == docs.count()
