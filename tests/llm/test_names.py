from castweave.llm import names

PEOPLE = [
    (1, "Kenneth Cadalamund"), (2, "Cadalamund, Kenneth"), (3, "Ken Cadalamund"), (4, 'Kenneth "Ken" Cadalamund'), (5, "K. Cadalamund"),
    (6, "Kenneth Cadalmund"), (7, "KENNETH CADALAMUND"), (8, "Dr. Kenneth Cadalamund, MD"), (9, "KennethCadalamund74"), (10, "@kennethcadalamund"),
    (11, "Omar Cadalamund"), (12, "Fiona Brumoz"), (13, "F. Brumoz"), (14, "Francesca Brumoz"), (15, "Gipomedun Comedy Troupe"),
    (16, "The Gipomedun Comedy Tr."), (17, "Gipomedun Comedy Troupe, Inc."), (18, "Gipomedun Media"), (19, "Andrew C. Tudokafal"),
    (20, "Andrew G. Tudokafal"), (21, None), (22, ""), (23, "!!!"), (24, "Søren Hisapopin"), (25, "Søøren Hisapopin"), (26, "Soren Hisapopin"),
    (27, "x" * 5000),
]


def test_signature():
    assert names.signature("Cadalamund, Kenneth A.") == (["kenneth", "cadalamund"], ["a"])
    assert names.signature("with Fiona O’Brien (guest)") == (["fiona", "obrien"], [])
    assert names.signature(None) is None and names.signature("?!") is None


def test_alignment():
    assert names.aligned(["john", "brerigakin"], ["brerigakin", "john"])
    assert not names.aligned(["leila", "brerigakin"], ["maeve", "brerigakin"])
    assert names.aligned(["maeve", "brerigakin"], ["maeve", "jane", "brerigakin"])
    assert not names.aligned([], ["a"])


def test_pairs(spark):
    person = spark.createDataFrame([(i, n, "clash", "g") for i, n in PEOPLE], "id long, name string, kind string, group_id string")
    entity = spark.createDataFrame(
        [("e1", "Walter Finumar", "walter finumar"), ("e2", None, "walter finumar"), ("e3", "", "rev walter finumar"), (None, "Walter Finumar", "x")],
        "entity_id string, display_name string, normalized_name string",
    )
    got = {tuple(r) for r in names.name_pairs(person, entity).collect()}
    groups = [range(1, 11), (15, 16, 17), (24, 25, 26)]
    want = {("person", *sorted((str(a), str(b)))) for g in groups for a in g for b in g if a < b}
    want |= {("entity", "e1", "e2"), ("entity", "e1", "e3"), ("entity", "e2", "e3")}
    assert got == want


def test_empty(spark):
    person = spark.createDataFrame([], "id long, name string")
    entity = spark.createDataFrame([], "entity_id string, display_name string, normalized_name string")
    assert names.name_pairs(person, entity).count() == 0


def test_same_result_as_all_pairs(spark):
    """The index loses no pair that a comparison of all spellings with one edit accepts."""
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(12)]
    typed = []
    for b in base:
        typed.append(f"Omar {b.title()}")
        k = rng.randrange(1, 8)
        typed.append(f"Omar {(b[:k] + b[k + 1 :]).title()}")
        typed.append(f"Omar {(b[:k] + 'z' + b[k:]).title()}")
    person = spark.createDataFrame(list(enumerate(typed)), "id long, name string")
    entity = spark.createDataFrame([], "entity_id string, display_name string, normalized_name string")
    got = {(r.left_key, r.right_key) for r in names.name_pairs(person, entity).collect()}
    for i in range(0, len(typed), 3):
        for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 2)):
            assert tuple(sorted((str(a), str(b)))) in got


def test_spellings_a_hub_refuses(spark):
    """Two spellings with one middle initial belong together, whatever other spelling is in their block."""
    typed = ["Jonathan A. Smith", "Jonathan B. Smith", "Jonathon B. Smith"]
    entity = spark.createDataFrame([], "entity_id string, display_name string, normalized_name string")
    for more in ([], ["Jonathan Smith"]):
        person = spark.createDataFrame(list(enumerate(typed + more)), "id long, name string")
        assert {(r.left_key, r.right_key) for r in names.name_pairs(person, entity).collect()} == {("1", "2")}


def groups_of(spark, typed):
    df = spark.createDataFrame([("p", str(i), n) for i, n in enumerate(typed)], "kind string, key string, name string")
    groups = {}
    for r in names.link_names(df).collect():
        groups.setdefault(r.group_id, set()).add(typed[int(r.key)])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_assignment_is_optimal():
    import random
    from itertools import permutations

    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 6)
        m = n + rng.randrange(0, 2)
        costs = [[rng.randrange(0, 10) for _ in range(m)] for _ in range(n)]
        assert names.assign(costs) == min(sum(costs[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))


def test_links_outside_the_lists(spark):
    same = [
        ("J. Kadamonde", "Josef Kadamonde"), ("Robert Smithson", "Robrt Smihtson"), ("Intl Trade Forum", "International Trade Forum"),
        ("Guadalupe Pelantor", "Lupe Pelantor"), ("Anna Maria Kelpatro", "Anna Kelpatro"), ("Jon Vitkuvar", "Jno Vitkuvar"),
        ("Grand Society of Northern Lakes and Rivers", "Grand Society of Northern Lakse and Rivers"), ("Reg. Affairs Council", "Regional Affairs Council"),
        ("@srenmukrasodun", "Søren Mukrasodun"),
    ]
    apart = ["Carla Dremipol", "Carlos Dremipol", "Ana Sutivek", "Olga Sutivek", "K. Trobavin", "Kasper Trobavin", "Kirsten Trobavin"]
    assert groups_of(spark, [n for pair in same for n in pair] + apart) == {frozenset(p) for p in same}


def test_planted_recall(spark):
    """Names, short forms and abbreviations in no list: at least 95% of the planted pairs are found, hardly any other."""
    import random
    from itertools import combinations

    rng = random.Random(17)
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou")
    word = lambda n: "".join(syllable() for _ in range(n)).title()

    def typo(w):
        k = rng.randrange(1, len(w) - 1)
        return rng.choice((w[:k] + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "x" + w[k:]))

    given = [word(4) for _ in range(12)]
    entities, typed = [], {}
    for i in range(120):
        g, s = rng.choice(given), word(5)
        entities.append([f"{g} {s}", f"{s}, {g}", f"{typo(g)} {typo(s)}", f'{g} "{g[:3]}ix" {s}', f"{g[:3]}ix {s}", f"{g[0]}. {s}", f"Dr. {g.upper()} {s.upper()}"])
        if i % 4 == 0:
            a, b = word(4), word(4)
            entities.append([f"{a} {b} Gazetteer", f"{a} {b} Gaz.", f"The {a} {typo(b)} Gazetteer"])
    for e, names_ in enumerate(entities):
        for n in names_:
            typed[n] = e
    want = {frozenset(p) for e in entities for p in combinations(set(e), 2)}
    got = {frozenset(p) for g in groups_of(spark, list(typed)) for p in combinations(g, 2)}
    assert len(want & got) >= 0.95 * len(want)
    assert len(got - want) <= 0.01 * len(got)
