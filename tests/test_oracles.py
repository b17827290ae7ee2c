import pytest
from helpers import same

from ledgerweave.plans import data_queries, evidence_queries, ledger_queries

CASES = [(m, n) for m in (data_queries, ledger_queries, evidence_queries) for n in m.ORACLES]


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query_equals_its_oracle(spark, module, name):
    same(spark, module.QUERIES[name], module.ORACLES[name])
