import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from attrita.session import checkpoint_dir, get_spark  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="attrita-tests", shuffle_partitions=4,
                  extra={"spark.ui.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)  # local tests only: a temporary folder when unset
    yield s


CANON_SCHEMA = ("customer_id long, credit_score int, geography string, gender string, age int, tenure int, "
                "balance double, num_products int, has_cr_card int, is_active_member int, "
                "estimated_salary double, exited int")


def customer_row(customer_id=1, credit_score=650, geography="France", gender="Male", age=35, tenure=5,
                 balance=75000.0, num_products=2, has_cr_card=1, is_active_member=1,
                 estimated_salary=100000.0, exited=0):
    return (customer_id, credit_score, geography, gender, age, tenure, balance, num_products, has_cr_card,
            is_active_member, estimated_salary, exited)
