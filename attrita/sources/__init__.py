from attrita.sources.tables import load_table, TABLE_NAMES
from attrita.sources.customer_csv import CUSTOMER_CSV_SCHEMA, read_customer_csv
from attrita.sources.profile import build_customer_profile

__all__ = ["load_table", "TABLE_NAMES", "CUSTOMER_CSV_SCHEMA", "read_customer_csv",
           "build_customer_profile"]
