"""Input and output contracts of the jobs, in one place.

These lists must equal what the jobs' consumers expect; everything that
reads or writes the tables takes its columns from here.
"""

# ---- columns of the two summary tables that the feature jobs read (name, type)
ORDER_SUMMARY = (
    ("productid", "string"), ("sellerid", "string"), ("merchantid", "string"), ("year", "int"), ("month", "int"),
    ("week", "int"), ("day", "int"), ("attrs", "string"), ("channel", "string"), ("price", "double"),
    ("disprice", "double"), ("finalprice", "double"), ("productcount", "bigint"), ("eventcount", "int"),
    ("stock", "int"))
VIEW_SUMMARY = (
    ("productid", "string"), ("sellerid", "string"), ("merchantid", "string"), ("year", "int"), ("month", "int"),
    ("week", "int"), ("day", "int"), ("brand", "string"), ("channel", "string"), ("fastseller", "string"),
    ("price", "double"), ("disprice", "double"), ("eventcount", "int"), ("productcount", "int"),
    ("scorefive", "int"), ("scorefour", "int"), ("scorethree", "int"), ("scoretwo", "int"), ("scoreone", "int"),
    ("sellergrade", "int"))

# ---- sink contract of the current-generation feature table, keys first
PRODUCT_ORDER_KEYS = ("productid", "year", "month", "week", "day")
PRODUCT_ORDER_CONTRACT = ("productid", "year", "month", "week", "day", "brandindexed",
                          "disprice", "finalprice", "numberofviews", "price", "productcount",
                          "relativebrand", "relativeprice", "scores", "sellergrade",
                          "sellerid", "stock")
PRODUCT_ORDER_MONTHLY_EXTRA = ("fastsellerindexed", "scorefive", "scorefour", "scorethree",
                               "scoretwo", "scoreone")

# ---- older-generation (merchant-level) contract: sink name ← source column
MERCHANT_ORDER_KEYS = ("productid", "sellerid", "channel", "year", "month", "week", "day")
MERCHANT_ORDER_CONTRACT = (
    ("productid", "productid"), ("sellerid", "sellerid"), ("channel", "channel"),
    ("year", "year"), ("month", "month"), ("week", "week"), ("day", "day"),
    ("attrs", "attrs"), ("brand", "brand1"), ("disprice", "disprice"),
    ("eventcount", "eventcount"), ("fastseller", "fastseller1"), ("finalprice", "finalprice"),
    ("numberofviews", "numberofviews1"), ("price", "price1"), ("productcount", "productcount"),
    ("scorefive", "scorefive1"), ("scorefour", "scorefour1"), ("scoreone", "scoreone1"),
    ("scorethree", "scorethree1"), ("scoretwo", "scoretwo1"), ("stock", "stock"),
)

# ---- merchant-level view statistics: keys, and the columns whose means get the suffix "1"
MERCHANT_VIEW_KEYS = ("merchantid", "productid", "brand", "channel", "fastseller", "sellerid")
MERCHANT_VIEW_MEANS = ("year", "month", "week", "day", "disprice", "eventcount", "price",
                       "productcount", "scorefive", "scorefour", "scorethree", "scoretwo",
                       "scoreone")

# ---- rollups: keys, means and sums
MONTHLY_KEYS = ("productid", "sellerid", "year", "month")
WEEKLY_KEYS = ("productid", "sellerid", "year", "month", "week")   # month stays: split weeks
MONTHLY_MEANS = ("brandindexed", "disprice", "fastsellerindexed", "finalprice", "price",
                 "scorefive", "scorefour", "scoreone", "scorethree", "scoretwo",
                 "sellergrade", "stock", "relativeprice")
WEEKLY_MEANS = ("brandindexed", "disprice", "finalprice", "price", "scores", "relativebrand",
                "sellergrade", "stock", "relativeprice")
# summed column → output name
MONTHLY_SUMS = (("numberofviews", "numberofviews"), ("productcount", "productcount"))
WEEKLY_SUMS = (("numberofviews", "numberofviews"), ("productcount", "label"))
LABEL_LIMIT = 20

# ---- feature vectors of the models, in vector order
WEEKLY_FEATURES = ("brandindexed", "disprice", "finalprice", "numberofviews", "price",
                   "relativebrand", "relativeprice", "scores", "sellergrade", "stock")
MONTHLY_FEATURES = ("brandindexed", "disprice", "fastsellerindexed", "finalprice", "numberofviews",
                    "price", "scorefive", "scorefour", "scorethree", "scoretwo", "scoreone",
                    "sellergrade", "stock", "relativeprice")
STOCK_FEATURES = ("disprice", "eventcount", "finalprice", "numberofviews", "price", "productcount",
                  "scorefive", "scorefour", "scorethree", "scoretwo", "scoreone", "channelindexed",
                  "yearindexed", "fastsellerindexed")
PRODUCT_FEATURES = ("channelindexed", "disprice", "eventcount", "finalprice", "price", "stock",
                    "fastsellerindexed", "scorefive", "scorefour", "scorethree", "scoretwo", "scoreone",
                    "sellergrade", "numberofviews", "brandindexed")
STOCK_INDEXED = {"channel": "channelindexed", "year": "yearindexed", "month": "monthindexed",
                 "week": "weekindexed", "brand": "brandindexed", "fastseller": "fastsellerindexed",
                 "stock": "stockindexed"}
