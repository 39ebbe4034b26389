"""These must equal the reference's for the same results.

They are stated here once, in the order the reference uses them, and imported
by the modules that need them.
"""

# --- Fixed values (must equal the reference's) -------------------------------

# Input text formats of the extracts.
BIRTHDATE_FORMAT = "M/d/yyyy"                  # month/day/year, one or two digits
ORDER_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"      # year-month-day hour:minute:second
SHIP_DATE_SENTINEL = "Cancelled"               # a ship date that means "none"
QUOTE = '"'                                    # stripped from both ends of names
PRICE_STRIP = '[$,"]'                          # characters removed from prices
ZIP_WIDTH = 5                                  # zips are five digits, zero padded
PRICE_PRECISION, PRICE_SCALE = 6, 2            # DECIMAL(6,2) prices
MONEY_SCALE = 2                                # totals rounded to cents

# Text built from columns.
NAME_SEP = " "                                 # first name, space, last name
BUYER_LIST_SEP = ","                           # buyers joined by a comma
ADDRESS2_MARK = " #"                           # before the second address line
CITY_STATE_SEP = ", "                          # city, state
STATE_ZIP_SEP = "   "                          # three spaces before the zip

# Column names of the view and field names of the four document sets, in order.
VIEW_COLUMNS = ["productID", "productName", "customers"]
PROD_FIELDS = ["ProductID", "ProductName", "ProductBuyers"]
BUYER_FIELDS = ["CustomerID", "CustomerName"]
CUST_FIELDS = ["CustomerID", "CustomerName", "PrintedAddress1", "PrintedAddress2", "Orders"]
ORDER_FIELDS = ["OrderID", "OrderTotal", "OrderDate", "ShippingDate", "Items"]
ITEM_FIELDS = ["ProductID", "Quantity", "ProductName"]
ZIP_FIELDS = ["ZIP", "State", "City", "PopularProducts"]
STATE_MONTH_FIELDS = ["OrderMonth", "State", "PopularProducts"]
POPULAR_FIELDS = ["TotalPurchases", "TotalSales", "ProductID", "ProductName"]
COLLECTIONS = ["prod", "cust", "custom1", "custom2"]

# Report settings as the reference sets them (the registered queries use
# values suited to the test tables instead, see possum.registry).
REPORT_STATE = "TX"
REPORT_STATE_PATTERN = ".* {state}   .*"        # matched on PrintedAddress2
REPORT_PRODUCT_ID = 1
REPORT_TOTAL_OVER = 20000
REPORT_QUANTITY_OVER = 10
REPORT_TOP_K = 20
REPORT_MONTH = 5
REFRESH_EVERY = "15 minutes"
