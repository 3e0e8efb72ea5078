"""Addresses: parsing, localities, the index, and what must stay apart."""

import itertools

import pytest
from pyspark.sql import functions as F

from kinmesh.llm import places


def found(spark, rows, units=False):
    df = spark.createDataFrame(rows, "seq bigint, parts array<string>, city string, post string").withColumn("n", F.lit(1)).withColumn("id", F.lit("x"))
    return {tuple(r) for r in places.Places(df).pairs(units).collect()}


@pytest.mark.parametrize(
    ("parts", "city", "want"),
    [
        (["36 West Silverkermore Lane"], "Great Marlowe", ("SILVERKERMORE", 36, "LN", "W", "", "GREATMARLOWE")),
        (["No. 888 Holmarshaw Sqr"], "Rampurvada", ("HOLMARSHAW", 888, "SQ", "", "", "RAMPURVADA")),
        (["C. CEDARPADSLE Nº 31, SAN LORIBIO"], "SAN LORIBIO", ("CEDARPADSLE", 31, "CALLE", "", "", "SANLORIBIO")),
        (["C/ Riverselhythe, n. 1439"], "Villarmena", ("RIVERSELHYTHE", 1439, "CALLE", "", "", "VILLARMENA")),
        (["P.º Coppergahouse, 73"], "Almedra", ("COPPERGAHOUSE", 73, "PASEO", "", "", "ALMEDRA")),
        (["Mapletertreestraße 44"], "Altenbrück", ("MAPLETERTREE", 44, "ST", "", "", "ALTENBRUCK")),
        (["ASHDEWYKEW. 805", None, "ALTENBRUCK 32601"], None, ("ASHDEWYKE", 805, "WEG", "", "", "ALTENBRUCK")),
        (["291 ELMLOLAND DRIVE", "#14"], "FT. ASHER", ("ELMLOLAND", 291, "DR", "", "14", "FORTASHER")),
        (["SILVERTERCROFT AVENUE #241"], "LOWER PENDLE", ("SILVERTERCROFT", 241, "AVE", "", "", "LOWERPENDLE")),
        (["Flat 3", "195 Falocngorpool Rd", "c/o Merwell"], "X Y", ("FALOCNGORPOOL", 195, "RD", "", "3", "XY")),
        (["104, HILBEMORE PLATZ", "WOHNUNG 24C"], "A", ("HILBEMORE", 104, "PL", "", "24C", "A")),
        (["AVENIDA - RIVERBELRIDGE 46"], None, ("RIVERBELRIDGE", 46, "AVE", "", "", "")),
        (["12 5th Avenue"], "X", ("5TH", 12, "AVE", "", "", "X")),
        (["9 Baker Street, 北京"], None, ("BAKER", 9, "ST", "", "", "北京")),
        (["улица Ленина 7"], "Омск", ("УЛИЦА ЛЕНИНА", 7, "", "", "", "ОМСК")),
    ],
)
def test_address_parts(parts, city, want):
    assert places.parse(parts, city, None)[:6] == want


def test_short_streets_and_long_numbers():
    assert places.parse(["12 ELM ST"], "X", None)[:3] == ("ELM", 12, "ST")
    assert places.parse(["7 Bay Ln."], None, None)[:3] == ("BAY", 7, "LN")
    assert places.parse(["12345 MAIN ST"], "X", None)[:3] == ("MAIN", 12345, "ST")
    assert places.parse(["12345 MAIN ST 54321"], "X", None)[6] == "54321"
    assert places.parse(["Hauptstrasse 5", "32601 Altenbruck"], None, None)[1] == 5
    assert places.parse(["12 ST"], "X", None) is None and places.parse(["32601 ALTENBRUCK"], None, None) is None


def test_addresses_without_place():
    assert places.parse([None, ""], "X", None) is None
    assert places.parse(["Somewhere"], "X", "12345") is None
    assert places.parse(["w" * 30_000], None, None) is None


def test_the_best_reading_wins():
    assert max(places.readings("N HIGH STREET".split()))[1:] == (["HIGH"], "ST", "N")
    assert max(places.readings("AVENUE ROAD".split()), key=lambda r: r[0])[1:] == (["ROAD"], "AVE", "")
    assert max(places.readings(["HIGH"]))[1:] == (["HIGH"], "", "")


def test_assignment_is_the_cheapest():
    def brute(a, b):
        alone = lambda t: 1 if t in places.KIND_OF or t in places.WAY_OF else 3
        a, b = sorted((a, b), key=len)
        best = 10**9
        for k in range(len(a) + 1):
            for left in itertools.combinations(range(len(a)), k):
                for right in itertools.permutations(range(len(b)), k):
                    cost = sum(places._token_cost(a[i], b[j]) for i, j in zip(left, right))
                    cost += sum(alone(t) for i, t in enumerate(a) if i not in left) + sum(alone(t) for j, t in enumerate(b) if j not in right)
                    best = min(best, cost)
        return best

    words = ["SAN", "MARTIN", "MARTINO", "W", "NORTH", "OAKHOLME", "OAKHOMLE", "M"]
    for a in itertools.chain.from_iterable(itertools.permutations(words, k) for k in (1, 2)):
        for b in itertools.permutations(words, 2):
            assert places.assignment(list(a), list(b)) == brute(list(a), list(b)), (a, b)
    assert places.assignment([f"A{i}" for i in range(40)], [f"B{i}" for i in range(40)]) > 1


def test_places(spark):
    rows = [
        (1, ["12 OAKHOLMEGATE ST APT 3"], "NORHAVEN", None), (2, ["No. 12 Oakholmegate Street"], "Norhaven.", None), (3, ["12 OAKHOLMGATE STRT"], None, None), (4, ["12 OAKHOLMEGATE RD"], "NORHAVEN", None),
        (5, ["12 OAKHOLMEGATE ST"], "TILLBROOK", None), (6, ["13 OAKHOLMEGATE ST"], "NORHAVEN", None), (7, [None], "NORHAVEN", None), (8, ["12 OAKHOLMEGATE ST APT 4"], "NORHAVEN", "1"), (9, ["12 OAKHOLMEGATE ST APT 4"], "NORHAVEN", "1"),
        (10, ["St. Oakholmegate 12"], None, None),
    ]
    # a missing city is no wildcard: two towns have that street and number, so 3 and 10 belong to neither
    assert found(spark, rows) == {(1, 2), (1, 8), (2, 8), (1, 9), (2, 9), (8, 9), (3, 10)}
    assert (1, 8) not in found(spark, rows, units=True) and (8, 9) in found(spark, rows, units=True)
    assert found(spark, []) == set()


def test_short_and_foreign_names(spark):
    rows = [
        (1, ["12 Elm Street"], "Miami", None), (2, ["12 ELM ST"], "MIAMI", None), (3, ["9 Baker Street, 北京"], None, None), (4, ["9 Baker St"], "London", None), (5, ["9 Baker St"], "Boston", None), (6, ["9 BAKER STREET"], "北京", None),
        (7, ["7 Garibaldi Road"], "Rome", None), (8, ["7 Garibaldi Road"], "Lome", None), (9, ["12345 Main Street"], "Miami", None), (10, ["12345 MAIN ST."], "Miami", None), (11, ["12 5th Avenue"], "Miami", None), (12, ["12 5TH AVE"], "Miami", None), (13, ["12 6TH AVE"], "Miami", None),
    ]
    assert found(spark, rows) == {(1, 2), (3, 6), (9, 10), (11, 12)}


def test_streets_alike_are_two_where_both_are_established(spark):
    """Two long rows of houses are two streets; one spelling of few houses is an error; other towns change nothing."""
    rows = [(i, [f"{i} Hillside Road"], "Leeds", None) for i in range(1, 21)] + [(100 + i, [f"{i} Millside Road"], "Leeds", None) for i in range(1, 21)] + [(1000 + i, [f"{i} Hillside Road"], "York", None) for i in range(1, 101)]
    rows += [(500, ["5 Hilside Road"], "Leeds", None), (501, ["6 Garden Way"], "Leeds", None), (502, ["6 Gardeen Way"], "Leeds", None)]
    got = found(spark, rows)
    assert got == {(5, 500), (501, 502)}


def test_two_errors_meet_through_the_street(spark):
    rows = [(1, ["72 Yargannway Dr"], "Great Marlowe", None), (2, ["72 Yraganway Dr"], "Great Marlowe", None), (3, ["80 Yarganway Dr"], "Great Marlowe", None)]
    assert found(spark, rows) == {(1, 2)}


def test_misspelt_streets_of_other_forms_of_a_place(spark):
    """Neighbouring streets, written equally often, meet without a city and by postcode area; other cities stay apart."""
    rows = [(1, ["1632 DUUNDAHURST"], "RAMPURVADA", None), (2, ["1632 DUNDAHURST"], None, None), (3, ["7 ELMGATEHOLM RD"], "NORHAVEN", "12345"), (4, ["7 ELMGATEHOLLM RD"], None, "12346"), (5, ["9 CEDARPADSLE RD"], "NORHAVEN", None), (6, ["9 CEDARPADSLEE RD"], "OBERTILL", None)]
    rows += [(7, ["8 PINEHURST RD"], "NORHAVEN", "12399"), (8, ["8 PINEHURST RD"], "WRONGTOWN", "12399")]
    assert found(spark, rows) == {(1, 2), (3, 4), (7, 8)}


def test_misspelt_localities(spark):
    rows = [(i, [f"{i} ELMGATEHOLM RD"], "NORHAVEN", None) for i in range(1, 31)] + [(40, ["3 ELMGATEHOLM RD"], "NORAHVEN", None), (41, ["4 ELMGATEHOLM RD"], "NRHAEVN", None)]
    assert found(spark, rows) == {(3, 40)}
