"""Documents with very many names are matched another way; the matches are the same."""

from landq.operators import rules
from landq.plans.fixtures import fx

SF = "/root/testdata/sf0.001"


def test_deceased_names_by_first_letters(spark, monkeypatch):
    owners, mutations = fx(spark, SF, "fx_owners"), fx(spark, SF, "fx_mutations")
    plain = sorted(map(tuple, rules.deceased_transferors(owners, mutations).collect()))
    monkeypatch.setattr(rules, "MANY_NAMES", 3)
    dense = sorted(map(tuple, rules.deceased_transferors(owners, mutations).collect()))
    assert dense == plain and len(plain) > 100
