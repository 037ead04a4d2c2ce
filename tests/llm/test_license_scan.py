import random

from shutterlake.llm import license_scan, queries
from tests.llm.oracle import same_as_sql

SCHEMA = "doc_id long, text string, word int"


def brute(text):
    """Every window against every template, without filters."""
    words = license_scan.words_of(text or "")
    out = set()
    for start in license_scan.window_starts(len(words)):
        block = set(words[start : start + license_scan.WINDOW])
        for t, (_, template) in enumerate(license_scan.TEMPLATES):
            own = set(license_scan.words_of(template))
            common = len(own & block)
            if common >= license_scan.least_overlap(len(own), license_scan.THRESHOLD):
                out.add((t, start, min(start + license_scan.WINDOW, len(words)), common / len(own)))
    return out


def texts():
    rng = random.Random(3)
    words = [w for _, t in license_scan.TEMPLATES for w in t.split()] + ["lorem", "Straße", "x1", "the", "mit"]
    for _ in range(150):
        body = [rng.choice(words) for _ in range(rng.choice([0, 3, 30, 33, 64, 65, 200]))]
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 4)):
                notice[rng.randrange(len(notice))] = rng.choice(words)
            at = rng.randint(0, len(body))
            body[at:at] = notice
        yield rng.choice([" ", "\n", "-"]).join(body)


def test_matches_equal_brute_force(spark):
    rows = [*enumerate(texts()), (1, None), (None, "Released under the MIT License"), (7, ""), (8, "! ?")]
    got = license_scan.scan(spark.createDataFrame([(*r, 5) for r in rows], SCHEMA)).collect()
    found = sorted((str(r["doc_id"]), r["n_words"], sorted((n["template"], n["first_word"], n["end_word"], n["containment"]) for n in r["notices"])) for r in got)
    assert found == sorted((str(d), len(license_scan.words_of(t or "")), sorted(brute(t))) for d, t in rows)
    assert sum(len(r["notices"]) for r in got) > 100


def test_phrases_and_digest(spark):
    rows = [(1, "GNU  General-Public\nLicense, or the apache license. Apache License"), (2, "cc by-nc; c c by"), (3, "commit license"), (4, None), (5, "Released under the mit-License!"), (6, "ÄPACHE LICENSE apache Ölicense"), (7, "cc by cc by")]
    got = {r["doc_id"]: r for r in license_scan.digest(license_scan.scan(spark.createDataFrame([(*r, 5) for r in rows], SCHEMA))).collect()}
    of = lambda d, *names: tuple(got[d][n] for n in names)
    assert of(1, "n_base", "first_word", "last_word", "base_labels", "score") == (3, 0, 8, "apache,gpl", 1.0)
    assert of(2, "n_words", "n_base", "first_word", "last_word", "base_labels") == (6, 1, 0, 0, "cc-by")
    assert of(3, "n_base", "first_word", "base_labels", "labels", "score") == (0, None, "", "", 0.0)
    assert of(4, "n_words", "n_base", "last_word", "labels", "score") == (0, 0, None, "", 0.0)
    assert of(5, "base_labels", "labels") == ("mit", "mit,notice:mit")
    assert of(6, "n_base", "n_words") == (0, 4)
    assert of(7, "n_base", "first_word", "last_word") == (2, 0, 2)


def test_longer_notice_without_phrase(spark):
    lead = "lorem ipsum " * 40
    notice = "Permission is hereby granted free of charge to any person who obtains a copy of this software and its associated documentation files"
    rows = [(1, lead + notice + " dolor" * 50, 0), (2, lead + notice.replace("software", "music").replace("copy", "song").replace("granted", "sung").replace("documentation", "poems") + lead, 0)]
    got = {r["doc_id"]: r for r in license_scan.digest(license_scan.scan(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[1]["labels"] == "notice:mit" and 0.8 <= got[1]["score"] < 1 and got[2]["labels"] == ""


def test_empty_table(spark):
    assert license_scan.digest(license_scan.scan(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_equals_sql(spark):
    same_as_sql(spark, "op12", queries.op12_license_scan, queries.ORACLE_SQL["op12_license_scan"], "/root/testdata/sf0.001", ["documents"])
