"""Vocabularies against a plain version that claims one surface after the other."""

from tempograph.operators import evaluate, vocabulary

YAML = "# languages\n---\nGo:\n  type: programming\n  aliases:\n  - golang\n  - 'go lang'\n  extensions:\n  - \".go\"\n\nC++:\n  aliases:\n  - cpp\n  color: x\n  - no\nNone:\n  type: data\n"
SKILLS = [
    ("b-go", "Go语言", "Go", ["golang", "", "Go 语言"], "a-code", "c1", "back", None),
    ("a-code", "编程", "Coding", ["Golang", "go  lang"], "", "c1", "back", None),
    ("c-cpp", "C++", "C++", [], None, "c2", "back", None),
    ("d-excel", "Excel", "MS excel", ["EXCEL"], None, "c2", "office", "C++"),
    ("e-code", "编程", "coding", None, None, "c2", "office", None),
]
NAMES = "slug string, name_zh string, name_en string, extra array<string>, parent string, cluster_id string, direction string, language string"
EXAMPLES = [("Excel", "N", 1), ("excel ", "Y", 2), ("MS Excel", "Y", 3), ("Excel", "Y", 4), ("", "Y", 5)]
MORE = [("b-go", 0, "Go-lang"), ("c-cpp", 0, "go语言"), ("c-cpp", 1, "C plus plus"), ("c-cpp", 2, "C plus plus")]


def plain():
    spoken = {"Go": ["golang", "go lang"], "C++": ["cpp"], "None": []}
    seen = {"Excel": True, "excel": True, "MS Excel": True}
    held, found = {}, {}
    for slug, zh, en, extra, _, _, _, language in sorted(SKILLS, key=lambda s: s[0]):
        extra, language = [x for x in extra or [] if x], language or en
        asked = [(zh, "curated")] + [(en, "curated")] * (en != zh) + [(x, "curated") for x in extra] + [(en.lower(), "curated")] * (en.lower() != zh)
        asked += [(x, "linguist") for x in spoken.get(language, [])]
        hit = next((h for c in [en, zh, *extra] for h in [c, *seen] if h in seen and h.lower() == c.lower()), None)
        asked += [(hit, "onet")] * (hit is not None) + [(a, "llm") for s, _, a in MORE if s == slug]
        aliases, sources = [], ["curated"] + ["linguist"] * (language in spoken) + ["onet"] * (hit is not None)
        for x, source in asked:
            surface = " ".join(x.split())
            key = surface.lower()
            if len(key) < 2 or key in evaluate.BLOCKED:
                continue
            held.setdefault(key, (surface, slug, source))
            if held[key][1] == slug and x not in aliases and x != zh:
                aliases.append(x)
                sources += [source] * (source not in sources)
        external = ({"linguist": language} if language in spoken else {}) | ({"onet": hit} if hit else {}) | ({"onet_hot": "Y"} if hit and seen[hit] else {})
        found[f"skill.{slug}"] = (aliases, sources, external)
    return held, found


def test_languages_of_yaml(spark):
    got = vocabulary.language_aliases(spark.createDataFrame([(YAML,), ("",), (None,)], "value string")).collect()
    assert {tuple(r) for r in got} == {("Go", 0, "golang"), ("Go", 1, "go lang"), ("C++", 0, "cpp"), ("None", None, None)}


def test_skills_equal_a_plain_build(spark):
    languages = vocabulary.language_aliases(spark.createDataFrame([(YAML,)], "value string"))
    examples = vocabulary.examples_of(spark.createDataFrame(EXAMPLES, "name string, hot_technology string, place int"))
    skills, aliases = vocabulary.build_skills(spark.createDataFrame(SKILLS, NAMES), languages, examples, spark.createDataFrame(MORE, "slug string, place int, alias string"), "1")
    held, found = plain()
    assert {r.surface_folded: (r.surface, r.skill_id, r.source) for r in aliases.collect()} == {k: (s, f"skill.{i}", o) for k, (s, i, o) in held.items()}
    rows = skills.collect()
    assert {r.id: (r.aliases, r.sources, r.external_ids) for r in rows} == found
    assert {r.id: r.parent_id for r in rows if r.parent_id} == {"skill.b-go": "skill.a-code"}
    clusters = vocabulary.build_clusters(spark.createDataFrame([("c1", "x", "x", "y"), ("c3", "x", "x", "y")], "id string, name string, name_en string, direction string"), skills, "1")
    assert {r.id: r.skill_ids for r in clusters.collect()} == {"c1": ["skill.a-code", "skill.b-go"], "c3": []}


def test_technical_groups(spark):
    df = spark.createDataFrame([("4-04-05",), ("4-04-05-07",), ("4-04-051",), ("4-04",), (None,)], "code string")
    assert [r[0] for r in df.select(vocabulary.is_technical(df.code)).collect()] == [True, True, False, False, False]
