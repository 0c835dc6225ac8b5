"""Every registered query of the engine against its SQL, over whole tables."""

import pytest

from lodestone.plans.oracles import ORACLES
from lodestone.plans.queries import REGISTERED

from .oracle import same


@pytest.mark.parametrize("name", list(REGISTERED))
def test_query_equals_sql(spark, sf_dir, name):
    same(REGISTERED[name](spark, sf_dir), ORACLES[name], sf_dir)
