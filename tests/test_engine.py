"""Sources, resolution, identity, fusion, confidence, projection and validation on invented people."""

import hashlib
import io
import json
import random
import zipfile
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from entityfusion.operators import confidence, dictionary, evidence, fusion, identity, projection, validation
from entityfusion.plans import pipeline
from entityfusion.plans.tables import Tables
from entityfusion.sources import ats_json, base, dictionaries, recruiter_csv, resume, sinks

CSV = 'full_name,email,phone,current_company,title,city,country,recruiter_notes,odd\nAda Quill,Ada@x.example.com;ada@y.example.com,+1 415 555 0101,Northwind,Software Developer,Lyon,France,"Good, solid",x\nNot Read,,,,,,,,\n'
ATS = {
    "candidateName": "Ada M. Quill", "primaryEmail": "ada@x.example.com", "mobile": "+14155550101", "technicalSkills": ["Python3", "Tensor Flow", "docker"], "skills": [{"name": "Python3"}, {"name": "Git"}],
    "employmentHistory": [{"company": "Northwind Labs", "title": "Software Engineer", "startDate": "2019-03-01", "endDate": "present", "highlights": ["did a", "did b"]}, {"summary": "neither"}],
    "educationHistory": [{"institution": "Uni Lyon", "degree": "BSc", "startYear": 2012, "endYear": "2015"}], "locationDetails": {"city": "Lyon", "country": "France"}, "links": {"linkedin": "https://www.linkedin.com/in/ada/", "blog url": "ada.example.com"},
}
RESUME = "Ada Quill\nada@x.example.com +1 (415) 555-0101\nLyon, France\nSummary\nSenior Backend-\nEngineer for data\nSkills\nPython, Django • REST API Development\nExperience\nBackend Developer at Northwind Mar 2019 - Present\n- built things\nEducation\n2012 - 2015 Bachelor of Science, Physics CGPA: 9\nUni Lyon, France\n"


@pytest.fixture(scope="module")
def fragments(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "a.csv").write_text(CSV)
    (d / "b.json").write_text(json.dumps(ATS))
    (d / "c.txt").write_text(RESUME)
    return recruiter_csv.read_csv(spark, str(d / "a.csv")).unionByName(ats_json.read_ats(spark, str(d / "b.json"), 1)).unionByName(resume.read_text(spark, str(d / "c.txt"), first_ord=2)).cache()


def test_csv(fragments, spark, tmp_path):
    r = fragments.filter("frag_ord = 0").first()
    assert r["full_name"] == "Ada Quill" and [e["normalized"] for e in r["emails"]] == ["ada@x.example.com", "ada@y.example.com"]
    assert r["headline"] == "Software Developer" and r["experience"][0]["summary"] == "Good, solid" and r["location"]["raw"] == "Lyon, France"
    (tmp_path / "a.csv").write_text(CSV)
    assert recruiter_csv.read_csv(spark, str(tmp_path / "a.csv"), all_rows=True).count() == 2


def test_ats(fragments):
    r = fragments.filter("frag_ord = 1").first()
    assert [s["name"] for s in r["skills"]] == ["Python3", "Tensor Flow", "docker", "Git"] and len(r["experience"]) == 1 and r["experience"][0]["end"] is None
    assert r["education"][0]["end_year"] == 2015 and r["links"]["linkedin"] == "https://linkedin.com/in/ada" and r["links"]["portfolio"] == "https://ada.example.com"


def test_ats_trees(spark):
    """Searches, names, places and odd records over the rows of trees."""
    tree = ats_json.Tree(F.col("_tree"))
    rows = lambda *texts: spark.createDataFrame([(t,) for t in texts], "raw string").withColumn("_tree", ats_json.tree_rows("raw"))
    first = lambda text: rows(text).select(tree.first("full_name")["text"]).first()[0]
    assert first('{"a": {"name": null, "z": {"name": "no"}}, "b": [{"full_NAME ": "yes"}], "name": "late"}') == "yes"
    assert first('{"a": {"x": 1}, "name": null, "b": {"name": "no"}}') is None and first('{"b": {"c": [{"name": 7}]}, "name": "late"}') == "7"
    assert [n["text"] for n in rows('{"skills": {"skills": ["a"]}}').select(F.explode(tree.all("skills")).alias("n")).select("n.*").collect()] == ["{'skills': ['a']}", "['a']"]
    texts = ["no json", "[1]", None, "", '{"a": ' * 3000 + "1" + "}" * 3000, "[" * 200_000 + "]" * 200_000, '{"skills": [{"label": "a; b"}, "c", null, 3, {"x": 1}], "location": "Pau, Bearn, France"}', '{"skills": {"x": 1}, "location": 5, "mail": [{"value": "A@x.example.com "}, 4, "b@x.example.com"]}']
    got = ats_json.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")).orderBy("i").select("parsed.*").collect()
    assert [r["quality"] for r in got] == [0.0, 0.0, 0.0, 0.0, got[4]["quality"], 0.0, 0.92, 0.92]
    assert [s["name"] for s in got[6]["skills"]] == ["a", "b", "c"] and got[6]["location"].asDict() == {"raw": "Pau, Bearn, France", "city": "Pau", "region": "Bearn", "country": "France", "country_code": None}
    assert [s["name"] for s in got[7]["skills"]] == ["{'x': 1}"] and [e["value"] for e in got[7]["emails"]] == ["a@x.example.com", "b@x.example.com"] and got[7]["location"]["raw"] is None


def test_ats_fallbacks(spark):
    """A current job needs employer and designation; a school by itself needs any of its parts; objects count beside lists."""
    texts = ['{"currentEmployer": "Northwind", "designation": "Cook", "profileSummary": "cooks"}', '{"currentEmployer": "Northwind"}', '{"x": {"school": "Uni"}, "major": "Law"}', '{"workHistory": {"employer": "A", "to": "Present", "from": "Mar 2019", "location": {"town": "Ulm"}}, "academics": {"course": "BSc", "toYear": "2O15", "fromYear": 2012}}']
    got = ats_json.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")).orderBy("i").select("parsed.*").collect()
    assert [[(j["company"], j["title"], j["summary"], str(j["start"]), j["end"]) for j in r["experience"]] for r in got] == [[("Northwind", "Cook", "cooks", "None", None)], [], [], [("A", "", None, "2019-03-01", None)]]
    assert [[(s["institution"], s["degree"], s["field"], s["start_year"], s["end_year"]) for s in r["education"]] for r in got] == [[], [], [("Uni", "", "Law", None, None)], [("", "BSc", None, 2012, None)]]
    assert got[3]["experience"][0]["location"]["city"] == "Ulm"


def test_ats_links(spark):
    """Own keys first, then containers: by a key's words, bare links by host; a taken portfolio leads to the others."""
    text = '{"linkedin": "linkedin.com/in/a", "a": [{"socialLinks": "https://github.com/a"}, {"links": "linkedin.com/in/b"}, {"links": "one.example.com"}, {"links": ["list.example.com"]}], "links": {"my_website": "two.example.com", "linkedin page": "x.example.com", "note": "no.example.com", "url": 5}}'
    assert ats_json.parsed(spark.createDataFrame([(text,)], "raw string")).select("parsed.links.*").first().asDict() == {
        "linkedin": "https://linkedin.com/in/a", "github": "https://github.com/a", "portfolio": "https://linkedin.com/in/b", "other": ["https://one.example.com", "https://two.example.com"]
    }


def test_resume(fragments):
    r = fragments.filter("frag_ord = 2").first()
    assert r["full_name"] == "Ada Quill" and [s["name"] for s in r["skills"]] == ["Python", "Django", "REST API Development"]
    assert r["experience"][0]["company"] == "Northwind" and r["experience"][0]["summary"] == "built things" and str(r["experience"][0]["start"]) == "2019-03-01"
    assert (r["education"][0]["degree"], r["education"][0]["field"], r["education"][0]["institution"]) == ("Bachelor of Science", "Physics", "Uni Lyon")


def test_resume_text(spark):
    """Sections that come twice, lines before any, heads with bullets and colons, words apart, links by slot, contacts from the raw text."""
    text = "Ada B.C. Quill\\nLyon, France\nsee https://www.linkedin.com/in/ada and www.a.example.com https://b.example.com\n• SKILLS::\nDatabases & Data Management SQLite, PostgreSQL\nJavaScript; testing|Git\nEducation\n2010 - 2012 BSc Percentage: 80\nAwards\nfirst prize\nskills\nIoT\nExperience\n- before any job\nCook, Cafe One (late) Jan 2001 – Feb 2002\n• made soup\nlanguages spoken\nwell\nBaker at Cafe Two Mar 2002 - present"
    r = resume.from_texts(spark.createDataFrame([(text,)], "raw string"), "raw", "resume_docx").first()
    assert r["full_name"] == "Ada B.C. Quill" and r["location"]["raw"] == "Lyon, France" and r["headline"] is None
    assert r["links"].asDict() == {"linkedin": "https://linkedin.com/in/ada", "github": None, "portfolio": "https://a.example.com", "other": ["https://b.example.com"]}
    assert [s["name"] for s in r["skills"]] == ["SQ Lite", "PostgreSQL", "JavaScript", "Git", "IoT"]
    jobs = [(j["title"], j["company"], str(j["start"]), j["end"] and str(j["end"]), j["summary"]) for j in r["experience"]]
    assert jobs == [("Cook", "Cafe One", "2001-01-01", "2002-02-01", "made soup well"), ("Baker", "Cafe Two", "2002-03-01", None, None)]
    assert [(s["degree"], s["field"], s["institution"], s["start_year"], s["end_year"]) for s in r["education"]] == [("B Sc", None, "", 2010, 2012)]
    told = {e["field"]: e["original"] for e in r["evidence"]}
    assert told["achievements"] == "first prize" and told["experience"] == "Baker at Cafe Two Mar 2002 - present" and "languages" not in told


def test_docx(spark, tmp_path):
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("Ada Quill", "ada@x.example.com", "Skills", "Python, Git"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = resume.read_docx(spark, str(tmp_path)).orderBy("frag_ord").collect()
    assert [s["name"] for s in rows[0]["skills"]] == ["Python", "Git"] and rows[1]["full_name"] is None and [r["frag_ord"] for r in rows] == [0, 1]


def test_log(tmp_path):
    for run in ("run-1", "run-2"):
        sinks.configure_logging(str(tmp_path / "deep" / "engine.log"), run)
        pipeline.LOG.info("something %s", 1)
    lines = (tmp_path / "deep" / "engine.log").read_text().splitlines()
    assert [x.split("[")[1] for x in lines] == [f"{r}] entityfusion.plans.pipeline: something 1" for r in ("run-1", "run-2")]


def test_stub_sources():
    with pytest.raises(NotImplementedError):
        base.REGISTRY["linkedin"]()
    with pytest.raises(ValueError):
        resume.read_any(None, "a.odt")


def test_resolution(spark):
    terms = dictionaries.terms(spark)
    values = spark.createDataFrame([("skills", v) for v in ("python3", "Python", "Tensor Flow", "zzz")] + [("companies", "BlueHarbor"), ("job_titles", "Technical Intern and Web developer"), ("degrees", None)], "domain string, value string")
    found = {r["value"]: (r["canonical"], r["stage"]) for r in dictionary.resolve(values, terms).collect()}
    assert found["python3"] == ("Python", "EXACT_ALIAS") and found["Python"] == ("Python", "CANONICAL_MATCH") and found["zzz"] == (None, "UNKNOWN_VALUE")
    assert found["BlueHarbor"] == ("Blue Harbor", "CANONICAL_MATCH") and found["Technical Intern and Web developer"] == ("Software Engineer", "FUZZY_MATCH")
    countries = dictionary.resolve_country(spark.createDataFrame([("india",), ("Atlantis",)], "value string"), terms)
    assert {r["value"]: r["country_code"] for r in countries.collect()} == {"india": "IN", "Atlantis": None}
    assert dictionary.check(terms).count() == 0 and dictionary.categories(terms, "countries").count() == 1


def test_later_alias_wins(spark):
    rows = [("d", 0, 0, "A", "a", False, "A", "c", None, [], {}), ("d", 0, 1, "x", "x", True, "A", "c", None, [], {}), ("d", 1, 0, "B", "b", False, "B", "k", None, ["A"], {}), ("d", 1, 1, "x", "x", True, "B", "k", None, [], {})]
    terms = spark.createDataFrame(rows, dictionary.TERMS)
    got = dictionary.resolve(spark.createDataFrame([("d", "x"), ("d", "k")], "domain string, value string"), terms, category_stages=True)
    assert {r["value"]: (r["canonical"], r["stage"]) for r in got.collect()} == {"x": ("B", "EXACT_ALIAS"), "k": ("B", "PARENT_CATEGORY")}
    assert dictionary.check(terms).count() == 1


def scan(keys):
    """The whole input in one scan: the cluster of each key as it goes."""
    at, out = {}, []
    for i, own in enumerate(keys):
        found = next((at[k[1:]] for k in own if k[1:] in at), i)
        out.append(found)
        at.update({k[1:]: found for k in own})
    return out


def clusters(spark, keys):
    frags = spark.createDataFrame([(str(i), i) for i in range(len(keys))], "frag_id string, frag_ord bigint")
    rows = [(str(i), i, j, *k) for i, ks in enumerate(keys) for j, k in enumerate(ks)]
    out = identity.greedy_clusters(frags, spark.createDataFrame(rows, identity.KEYS).repartition(7), Tables(spark, "t")).collect()
    return [r["cluster_ord"] for r in sorted(out, key=lambda r: r["frag_ord"])], {r["cluster_ord"]: (r["key_used"], r["confidence"]) for r in out}


def test_greedy_is_not_connected(spark):
    e, p = (1, "email", "e"), (2, "phone", "p")
    got, used = clusters(spark, [[e], [p], [e, p], [p]])
    assert got == [0, 1, 0, 0] and used == {0: ("email", 0.98), 1: (identity.NEW, 0.0)}


def test_greedy_against_whole_scan(spark):
    rng = random.Random(5)
    keys = [[(p, k, str(rng.randint(0, 60))) for p, k in enumerate(("linkedin_url", "email", "phone")) if rng.random() < 0.5] for _ in range(150)]
    assert clusters(spark, keys)[0] == scan(keys)


def test_greedy_hot_key(spark):
    """A key that half of the fragments share, over several ranges, and keys that come twice in a fragment."""
    rng = random.Random(8)
    keys = [[(1, "email", "hot")] * rng.randint(0, 2) * (rng.random() < 0.5) + [(2, "phone", str(rng.randint(0, 400)))] for _ in range(1500)]
    assert clusters(spark, keys)[0] == scan(keys)


def test_fuzzy_in_blocks(spark, monkeypatch):
    """Blocks of terms find what one list does, ties in dictionary order."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(3, 6)))
    terms = spark.createDataFrame([(rng.choice("xy"), i, j, t, t, j > 0, f"c{i}", "k", None, [], {}) for i in range(30) for j in range(3) for t in [word()]], dictionary.TERMS)
    values = spark.createDataFrame([(d, word()) for d in "xyz" for _ in range(40)], "domain string, value string").distinct()
    whole = {tuple(r) for r in dictionary.fuzzy_best(values, terms, 60).collect()}
    monkeypatch.setattr(dictionary, "BLOCK_TERMS", 4)
    assert {tuple(r) for r in dictionary.fuzzy_best(values, terms, 60).collect()} == whole and any(f is not None for *_, f in whole)


def test_links(spark):
    rows = [(1, 0, "linkedin", "linkedin.com/a"), (1, 1, "linkedin", "linkedin.com/b"), (1, 2, "other", "linkedin.com/b"), (1, 3, "other", "x.example.com"), (1, 4, "other", "www.x.example.com/"), (1, 5, "github", None)]
    got = fusion.merge_links(spark.createDataFrame(rows, "cluster int, ord int, slot string, url string")).first()
    assert got["linkedin"] == "linkedin.com/a" and got["github"] is None and got["other"] == ["x.example.com"]


def test_location_and_union(spark):
    rows = [(1, 0, ("r", "a", None, None, None), 0.9), (1, 1, ("r", "b", None, "F", None), 0.5), (1, 2, ("r", "c", None, "F", "FR"), 0.5)]
    df = spark.createDataFrame(rows, "cluster int, ord int, location struct<raw:string,city:string,region:string,country:string,country_code:string>, s double")
    assert fusion.most_complete(df, F.col("s")).first()["location"]["city"] == "b"
    items = spark.createDataFrame([(1, 2, "k", "B", 0.4, ["x", "y"]), (1, 1, "k", "A", 0.2, ["y"]), (1, 3, None, "C", 1.0, [])], "cluster int, ord int, key string, name string, c double, l array<string>")
    got = fusion.union_values(items, "key", F.col("c"), ("name",), ("l",)).first()
    assert (got["ord"], got["name"], got["confidence"], got["l"]) == (1, "A", 0.4, ["y", "x"])


def test_evidence(spark):
    df = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "a", "z")], "cluster int, ord int, id string, v string")
    assert sorted((r["id"], r["ord"], r["v"]) for r in evidence.dedupe_last(df, "id").collect()) == [("a", 0, "z"), ("b", 1, "y")]
    p = spark.createDataFrame([(1, i, "f", "s", "m", "r", o, None, c) for i, (o, c) in enumerate([("x", 0.1), ("y", 0.9), ("x", 0.3)])], "cluster int, ord int, field string, source string, method string, rule string, original string, canonical string, confidence double")
    got = evidence.compact_provenance(p).first()
    assert got["original"] == '["x","y"]' and got["confidence"] == 0.9 and got["canonical"] is None


@pytest.fixture(scope="module")
def result(spark, fragments):
    return pipeline.run(fragments, dictionaries.terms(spark))


def test_whole_plan(result):
    assert result.clusters.select("cluster_ord", "key_used", "confidence").distinct().collect() == [(0, "email", 0.98)]
    r = result.canonical.first()
    assert r["full_name"] == "Ada M. Quill" and [s["name"] for s in r["skills"]] == ["Python", "TensorFlow", "Docker", "Git", "Django", "REST API Development"]
    assert len(r["experience"]) == 1 and r["experience"][0]["company_canonical"] == "Northwind Labs" and str(r["experience"][0]["start"]) == "2019-03-01"
    assert len(r["education"]) == 1 and r["education"][0]["degree_canonical"] == "Bachelor of Science" and r["location"]["country_code"] == "FR"
    assert 0 < r["overall_confidence"] < 1 and len(r["provenance"]) > 3
    assert result.fields.count() == 10 and result.summary.first()["candidates"] == 1


def test_decisions(result):
    """One decision a field, with the reasons of each; lists count as sure, a value that nobody gives does not."""
    made = {r["field"]: r for r in result.decisions.collect()}
    assert set(made) == set(fusion.STRATEGIES)
    assert made["emails"]["reason"] == "strong_cross_source_agreement" and made["emails"]["selected"] == ["ada@x.example.com", "ada@y.example.com"] and made["emails"]["rejected"] == []
    assert made["skills"]["reason"] == "semantic_alias_match" and made["skills"]["strategy"] == "semantic_union" and made["experience"]["strategy"] == "chronological_merge"
    assert made["experience"]["competing"][1] == "Northwind Labs|Software Engineer|2019-03-01|None" and made["experience"]["reason"] == "high_source_reliability"
    assert made["years_experience"]["competing"] == [] and made["years_experience"]["confidence"] == 0.0 and made["years_experience"]["reason"] == "high_source_reliability"
    assert made["headline"]["confidence"] == 1.0 and made["headline"]["reason"] == "high_source_reliability" and len(made["headline"]["competing"]) == 3
    assert made["location"]["selected"][:2] == ["Lyon, France", "Lyon"] and made["location"]["reason"] == "strong_cross_source_agreement"
    trail = result.provenance.filter("method = 'merge'").collect()
    assert {r["field"] for r in trail} == set(made)


def test_skills_from_evidence(spark):
    """Evidence of skills is read again, parted by commas; lists count only where no evidence tells."""
    csv = [(0, "full_name,email,skills\nAda Quill,a@x.example.com,\"python3, Git;zz\"\n")]
    made = recruiter_csv.rows(spark.createDataFrame([("f", bytearray(t, "utf-8")) for _, t in csv], "path string, content binary"), False).withColumns({"record_id": F.lit("r"), "frag_ord": F.lit(0).cast("long")})
    frags = base.fragments_of(made.withColumn("parsed", recruiter_csv.shaped(F.col("have"))))
    assert [r["item"]["name"] for r in pipeline.told_skills(frags).orderBy("ord").collect()] == ["python3", "Git;zz"]
    none = frags.withColumn("evidence", F.expr("filter(evidence, e -> e.field <> 'skills')"))
    assert [r["item"]["name"] for r in pipeline.told_skills(none).orderBy("ord").collect()] == ["python3", "Git", "zz"]


def test_settings(spark, fragments, result, tmp_path):
    """Weights, reliabilities and policies of files change scores and strategies; missing files change nothing."""
    from entityfusion.settings import DEFAULT, load_settings

    assert load_settings(str(tmp_path)) == DEFAULT
    (tmp_path / "fusion.yml").write_text("merge_policies:\n  emails: pile\nidentity_resolution:\n  case_insensitive: false\n")
    (tmp_path / "confidence.yml").write_text("score_components:\n  source_reliability_weight: 0.9\ncategory_weights: {}\ncaps:\n  single_source_max: 0.5\n")
    (tmp_path / "source_reliability.yml").write_text("reliability:\n  recruiter_csv: 0.1\n")
    own = load_settings(str(tmp_path))
    assert own.reliability == {"recruiter_csv": 0.1} and own.overrides == DEFAULT.overrides and own.weights["reliability"] == 0.9 and own.weights["missing"] == 0.1 and not own.case_insensitive
    again = pipeline.run(fragments, dictionaries.terms(spark), settings=own)
    assert {r["strategy"] for r in again.decisions.filter("field = 'emails'").collect()} == {"pile"}
    assert again.canonical.first()["overall_confidence"] != result.canonical.first()["overall_confidence"]
    (tmp_path / "fusion.yml").write_text("- no mapping\n")
    with pytest.raises(ValueError):
        load_settings(str(tmp_path))


def test_without_category_weights(spark):
    from entityfusion.settings import Settings

    df = spark.createDataFrame([(1, "emails", 0.5, 3, 0.0), (1, "skills", 0.9, 0, 0.0), (1, "headline", 0.1, 1, 0.0)], "cluster int, field string, score double, source_count int, conflict double")
    overall = lambda s: confidence.overall_confidence(df, settings=s).first()["overall"]
    assert overall(Settings(category_weights={})) == pytest.approx((0.5 * 3 + 0.9 + 0.1) / 5)
    assert overall(Settings(category_weights={"other": 1.0})) == pytest.approx(0.5) and overall(Settings()) == pytest.approx((0.5 * 0.3 + 0.9 * 0.2 + 0.1 * 0.05) / 0.55)


def test_records_need_ids(spark):
    df = spark.createDataFrame([("a",), (None,)], "candidate_id string")
    assert validation.finalized(df.limit(1)).count() == 1
    with pytest.raises(Exception, match="without candidate_id"):
        validation.finalized(df).collect()


def test_csv_files_differ(spark, tmp_path):
    """Headers of each file's own, Latin-1 where it is no UTF-8, no rows, quoted line breaks."""
    (tmp_path / "a.csv").write_bytes("Name,MAIL,x\nJos\xe9 Quill,j@x.example.com,1\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("email,full_name,candidate_name\nb@x.example.com,Old,\"Ben\nMoss\"\nc@x.example.com,Cy,Cy Lo\n")
    (tmp_path / "c.csv").write_text("name,email\n")
    got = [(r["frag_ord"], r["full_name"], [e["value"] for e in r["emails"]], r["quality"]) for r in recruiter_csv.read_csv(spark, str(tmp_path), first_ord=5).orderBy("frag_ord").collect()]
    assert got == [(5, "José Quill", ["j@x.example.com"], 0.92), (6, "Ben Moss", ["b@x.example.com"], 0.92), (7, None, [], 0.0)]
    assert [r["full_name"] for r in recruiter_csv.read_csv(spark, str(tmp_path), all_rows=True).orderBy("frag_ord").collect()] == ["José Quill", "Ben Moss", "Cy Lo", None]


def test_fold_against_whole_scan():
    """Looking only at items that share a key finds what looking at all does."""
    rng = random.Random(9)

    def item():
        year = rng.choice([None, 2001, 2005, 2010])
        company, title = rng.choice(["a", "ab", "abc", "b"]), rng.choice(["t", "u", "tu"])
        canonical = rng.choice([None, None, "a", "b"])
        return {
            "company": company, "title": title, "company_canonical": canonical, "title_canonical": rng.choice([None, "t"]), "start": year and date(year, 1, 1), "end": year and rng.choice([None, date(year + 2, 1, 1)]), "summary": rng.choice([None, "x y", "x z w"]),
            "location": None, "confidence": rng.random(), "evidence_ids": [], "company_key": company, "company_canonical_key": canonical,
        }

    def plain(items):
        merged = []
        for x in items:
            at = next((m for m in merged if fusion.same_experience(m, x)), None)
            if at is None:
                merged.append(fusion.first_experience(dict(x)))
            else:
                fusion.add_experience(at, x)
        return sorted(merged, key=fusion.experience_order)

    for _ in range(300):
        items = [item() for _ in range(rng.randint(0, 12))]
        assert fusion.fold_items(items, fusion.EXPERIENCE) == plain(items)


def test_order_of_partitions_does_not_matter(spark, fragments, result):
    again = pipeline.run(fragments.repartition(5, F.rand(3)), dictionaries.terms(spark)).canonical.first()
    assert again == result.canonical.first()


def test_confidence_formula(spark):
    df = spark.createDataFrame([(0.9, 0.75, 0.92, 0.2, 0.5, 0.0)], "a double, b double, c double, d double, e double, f double")
    want = (0.9 * 0.3 + 0.75 * 0.25 + 0.92 * 0.2 + 0.2 * 0.2) / 0.95 - 0.5 * 0.05
    assert df.select(confidence.score(*(F.col(c) for c in "abcdef"))).first()[0] == pytest.approx(want)
    assert df.select(confidence.capped(F.lit(0.9), F.lit(1), F.lit(0), F.lit(10)), confidence.capped(F.lit(0.9), F.lit(2), F.lit(5), F.lit(10))).first()[:] == (0.85, 0.78)


def test_projection(result, tmp_path):
    config = projection.config_from({"fields": ["full_name", {"path": "contact.email", "from": "emails[0]"}, {"path": "phones", "normalize": "E164"}, {"path": "skills", "normalize": "canonical"}, {"path": "country", "from": "location", "normalize": "iso3166"}, {"path": "x", "from": "emails[9]"}, {"path": "off", "from": "full_name", "enabled": False}], "on_missing": "omit", "include_provenance": False})
    shown = projection.project(result.canonical.drop("cluster"), config)
    payload = json.loads(projection.as_json(shown, config).first()["payload"])
    assert payload["contact"] == {"email": "ada@x.example.com"} and payload["country"] == "FR" and payload["skills"][0] == "Python" and "x" not in payload and "off" not in payload and "overall_confidence" in payload
    sinks.write_single_json(projection.as_json(shown, config), str(tmp_path / "deep" / "o.json"))
    assert json.loads((tmp_path / "deep" / "o.json").read_text())["full_name"] == "Ada M. Quill"
    assert {"candidate_id", "emails", "phones", "skills", "experience", "education", "provenance", "overall_confidence"} <= set(result.projected.columns)


def test_missing_error(result):
    config = projection.config_from({"fields": [{"path": "x", "from": "emails[9]"}], "on_missing": "error"})
    with pytest.raises(Exception, match="Missing projected field: x"):
        projection.project(result.canonical, config).collect()
    with pytest.raises(ValueError):
        projection.config_from({"fields": [], "on_missing": "maybe"})
    assert projection.config_from({"fields": []}).mode == "custom" and projection.config_from({"rules": []}).mode == "default"


def test_validation(spark):
    df = spark.createDataFrame([("1", ["+14155550101", "415"], "us", [], "2020-13")], "candidate_id string, phones array<string>, country string, skills array<string>, d string")
    rules = (projection.Rule("phones", "phones", "e164"), projection.Rule("country", "country", "iso3166"), projection.Rule("skills", "skills", required=True, enabled=False))
    got = validation.validate(df, projection.Config("custom", rules)).collect()
    assert sorted((r["path"], r["code"]) for r in got) == [("country", "invalid_country_code"), ("phones[1]", "invalid_phone_format"), ("skills", "missing_required_field")]


def test_default_validation(result):
    codes = {r["code"] for r in result.issues.collect()}
    assert codes <= {"invalid_phone_format"}


def test_yaml_dictionary(spark, tmp_path):
    (tmp_path / "d.yml").write_text("﻿ontology_name: d\nversion: '1'\nentries:\n  - canonical_name: A\n    aliases: [x]\n    category: c\n", encoding="utf-8")
    assert dictionaries.read_yaml(spark, "d", str(tmp_path / "d.yml")).count() == 2
    (tmp_path / "bad.yml").write_text("entries: []")
    with pytest.raises(ValueError):
        dictionaries.read_yaml(spark, "d", str(tmp_path / "bad.yml"))
    with pytest.raises(FileNotFoundError):
        dictionaries.read_yaml(spark, "d", str(tmp_path / "none.yml"))


def test_stream(spark, tmp_path):
    from entityfusion.streaming import ingest

    (tmp_path / "in").mkdir()
    for i, name in enumerate(("Ada Quill", "Ben Moss", "Ada Quill")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"name": name}))
    for _ in range(2):  # the second run finds nothing new
        ingest.write(ingest.fragments(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r["full_name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Ada Quill", "Ben Moss"]


def test_ordinals_beyond_64_bits(spark):
    """Fragments numbered from 2^62 on, and the longest lists, keep their order."""
    one = pipeline.ordinal(F.col("f"), F.col("a"), F.col("p"))
    rows = spark.createDataFrame([((1 << 62) + 1, 0, 0), (1 << 62, (1 << 31) - 1, (1 << 31) - 1), (1 << 62, 300_000, 5000), (1 << 62, 300_000, 4999), (1 << 62, 1, 0)], "f bigint, a int, p int")
    assert [(r["a"], r["p"]) for r in rows.orderBy(one).collect()] == [(1, 0), (300_000, 4999), (300_000, 5000), ((1 << 31) - 1, (1 << 31) - 1), (0, 0)]


def test_closed_run(spark, fragments, tmp_path):
    """What is wanted is written elsewhere, then a run leaves nothing in the shared folder."""
    made = pipeline.run(fragments, dictionaries.terms(spark))
    root = Path(made.tables.root.removeprefix("file://"))
    made.projected.write.parquet(str(tmp_path / "out"))
    assert any(root.iterdir())
    made.close()
    assert not root.exists() and spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_stored_trail_ids_and_contact_evidence(spark, fragments, result):
    """Provenance that fragments bring comes first; entities without an id get one of all they are made of; contacts name their field's evidence;
    numbers from 2^60 on change nothing."""
    frag = [r["frag_id"] for r in fragments.orderBy("frag_ord").collect()]
    stored = spark.createDataFrame([(frag[0], 0, "full_name", "A. Quill", "Ada Quill", "archive", "import", "kept", 0.4, "r0"), (frag[0], 1, "emails", "ada@x.example.com", "ada@x.example.com", "recruiter_csv", "csv", "older rule", 0.1, "r1")], pipeline.STORED)
    far = fragments.withColumn("frag_ord", F.col("frag_ord") + (1 << 60)).withColumn("external_id", F.lit(None).cast("string"))
    row = pipeline.run(far, dictionaries.terms(spark), stored=stored).canonical.first()
    assert all(row[c] == result.canonical.first()[c] for c in ("full_name", "emails", "phones", "location", "links", "skills", "experience", "education"))
    trail = [(p["field"], p["source"], p["method"], p["rule"]) for p in row["provenance"]]
    assert trail[:2] == [("full_name", "archive", "import", "kept"), ("emails", "recruiter_csv", "csv", "older rule")] and len(trail) > 10
    assert [t for t in trail if t[:3] == ("emails", "recruiter_csv", "csv")] != [] and trail[-1][1] == "fusion"
    phone = row["phones"][0]["e164"]
    want = hashlib.sha256("::".join([row["full_name"].lower(), row["emails"][0]["normalized"], phone, *frag]).encode()).hexdigest()
    assert row["candidate_id"] == want
    told = {e["evidence_id"] for r in fragments.collect() for e in r["evidence"] if e["field"] == "emails"}
    first = row["emails"][0]["evidence_ids"]
    assert len(first) > 1 and set(first) <= told
