"""Flat order-line schema shared by every operator.

One row is one order line. Money is DECIMAL so that sums are exact and do
not depend on the order in which partitions are combined; it becomes DOUBLE
only in the final projection of each analysis.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
RATE = T.DecimalType(6, 4)

ORDER_LINE_SCHEMA = T.StructType(
    [
        T.StructField("Row_ID", T.LongType(), True),
        T.StructField("Order_ID", T.StringType(), True),
        T.StructField("Order_Date", T.DateType(), True),
        T.StructField("Ship_Date", T.DateType(), True),
        T.StructField("Ship_Mode", T.StringType(), True),
        T.StructField("Customer_ID", T.StringType(), True),
        T.StructField("Customer_Name", T.StringType(), True),
        T.StructField("Segment", T.StringType(), True),
        T.StructField("Country", T.StringType(), True),
        T.StructField("Market", T.StringType(), True),
        T.StructField("Region", T.StringType(), True),
        T.StructField("Product_ID", T.StringType(), True),
        T.StructField("Category", T.StringType(), True),
        T.StructField("Sub_Category", T.StringType(), True),
        T.StructField("Quantity", T.IntegerType(), True),
        T.StructField("Discount", RATE, True),
        T.StructField("Sales", MONEY, True),
        T.StructField("Profit", MONEY, True),
    ]
)

# Loaded by the CSV ingest but used by no analysis.
SHIPPING_COST = T.StructField("Shipping_Cost", MONEY, True)

CUSTOMER_KEYS = ["Customer_ID", "Customer_Name", "Segment"]

#: Columns whose number of values a business's dimensions bound, whatever the number
#: of lines. Groups of these alone may be ranked or totalled in one task.
BOUNDED_COLUMNS = frozenset({"Market", "Region", "Country", "Segment", "Ship_Mode", "Category", "Sub_Category"})
