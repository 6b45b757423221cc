from lorewell.operators.conjoint import COLLECTION, INDIVIDUAL, Cell, Grid, Queue, cases, heaviest


def q(*cells, start=0, parent=-1, relation="isaGenls"):
    return Queue(start, [Cell(relation, a, w) for a, w in cells], parent)


def test_heavier_side_wins_and_both_kinds_come_out():
    g = Grid([q(("Dog", 1.0)), q(("Mammal", 0.5)), q(("Plant", 0.9))], [("Dog", "Plant"), ("Plant", "Mammal")])
    got = heaviest(g, most=None)
    assert [(k, sorted(a for _, a in f)) for k, _, _, f in got] == [(INDIVIDUAL, ["Dog", "Mammal"]), (COLLECTION, ["Dog", "Mammal"]), (INDIVIDUAL, ["Plant"]), (COLLECTION, ["Plant"])]
    assert abs(got[0][1] - 1.5 / 3.4) < 1e-9 and abs(got[1][1] - 1.5 / 3.4 * 0.9999) < 1e-9
    assert {r for r, _ in got[0][3]} == {"isa"} and {r for r, _ in got[1][3]} == {"genls"}


def test_next_row_is_taken_where_the_first_clashes():
    g = Grid([q(("Dog", 1.0)), q(("Plant", 0.8), ("Pet", 0.3))], [("Dog", "Plant")])
    kind, weight, seed, found = heaviest(g)[0]
    assert (kind, seed, found) == (INDIVIDUAL, ("isa", "Dog"), [("isa", "Dog"), ("isa", "Pet")])
    assert abs(weight - 1.3 / 2.8) < 1e-9


def test_equal_weights_below_are_taken_too_and_count_once():
    g = Grid([q(("Dog", 1.0), ("Pet", 1.0), ("Guard", 0.5))], [])
    assert heaviest(g)[0][1:] == (0.5, ("isa", "Pet"), [("isa", "Dog"), ("isa", "Pet")])


def test_fallback_column_only_where_its_parent_fails():
    parent, child = q(("Plant", 0.6)), q(("Grass", 0.6), start=1, parent=0)
    assert [a for _, a in heaviest(Grid([parent, child], []))[0][3]] == ["Plant"]
    g = Grid([parent, child, q(("Dog", 1.0))], [("Dog", "Plant")])
    assert [a for _, a in heaviest(g)[0][3]] == ["Dog", "Grass"]


def test_constraints_become_truths():
    rules = {("owner", 1): (("isa", "Person"), ("isa", "Thing"))}
    owner = Queue(0, [Cell("owner", "Rex", 1.0)])
    g = Grid([owner, q(("Dog", 0.9))], [("Person", "Dog")], rules)
    assert heaviest(g, coll=0.0)[0][3] == [("isa", "Person"), ("owner", "Rex")]
    assert heaviest(g, coll=0.0, isa=["Dog"])[0][3] == [("isa", "Dog")]
    # As a collection, what the thing is and what lies above it are apart.
    assert heaviest(g)[0][0] == COLLECTION and heaviest(g)[0][3] == [("isa", "Person"), ("owner", "Rex"), ("genls", "Dog")]


def test_standing_and_truths_decide_the_kind():
    g = Grid([q(("Dog", 1.0))], [("Collection", "Agent")])
    assert heaviest(g, ind=0.2, coll=0.8)[0][0] == COLLECTION
    assert [k for k, *_ in heaviest(g, ind=0.2, coll=0.8, isa=["Agent"], most=None)] == [INDIVIDUAL]
    assert heaviest(Grid([], [])) == [] and [k for k, *_ in heaviest(g, ind=1.0, coll=0.0, most=None)] == [INDIVIDUAL]


def test_cases_of_modules(spark):
    cells = spark.createDataFrame([(1, 0, 0, None, "isaGenls", "Dog", 1.0, 1), (1, 1, 0, None, "owner", "Rex", 0.5, 1), (2, 0, 0, None, "isa", "Cat", 1.0, 1), (2, 3, 1, 0, "isa", "Pet", 0.5, 1)], "module int, x int, y int, parent int, relation string, arg string, weight double, position int")
    rules = spark.createDataFrame([("owner", 1, "isa", "Person")], "relation string, position int, kind string, term string")
    told = spark.createDataFrame([(2, "isa", "Stone")], "module int, kind string, term string")
    apart = spark.createDataFrame([("Dog", "Person"), ("Cat", "Stone")], "a string, b string")
    kinds = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, 0.0)], "module int, ind double, coll double")
    got = {r.module: r for r in cases(cells, apart, rules, told, kinds).collect()}
    assert [tuple(a) for a in got[1].assertions] == [("isa", "Dog")] and got[1].seed == "isa Dog"
    assert [tuple(a) for a in got[2].assertions] == [("isa", "Pet")]
