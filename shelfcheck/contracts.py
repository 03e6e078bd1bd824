"""Dataset contracts: canonical column names, declared types and key fields.

Everything between the two FIXED VALUES markers must equal what the source exports
and the reports use, character for character; it is data, not logic.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (begin)
# ---------------------------------------------------------------------------

# Reconciliation flags, in their display order (the flag index is the position).
FLAGS = [
    "存在差异",  # DIFF
    "伯俊负库存",  # NEG_BOOK
    "仅平台有货(伯俊无此品)",  # ONLY_PLATFORM
    "平台均未上架",  # UNLISTED
    "平台虚拟库存",  # VIRTUAL
    "三方一致",  # SAME
]
FLAG_DIFF, FLAG_NEG_BOOK, FLAG_ONLY_PLATFORM, FLAG_UNLISTED, FLAG_VIRTUAL, FLAG_SAME = FLAGS

# Store remarks that take a store out of reconciliation (closed, airport).
INACTIVE_REMARKS = ["闭店", "机场店"]

# Outlet states that count as live.
JD_LIVE_STORE_STATUS = "启用"
MT_LIVE_BUSINESS_STATUS = "营业中"

# Platform labels.
PLATFORM_JD = "京东"
PLATFORM_MT = "美团"
PLATFORM_ELEME = "饿了么"

# Outlet guard status labels (met / short).
GUARD_MET = "达标"
GUARD_SHORT = "不足"

# Map point types, in index order: own store, jd outlet, mt outlet.
POINT_TYPES = ["专卖店", "京东网点", "美团网点"]

# Geocode levels that only place a point at an administrative centre.
COARSE_GEO_LEVELS = ["国家", "省", "市", "区县", "未知"]

# Geocode error codes after which a run must stop.
FATAL_GEO_CODES = ["10001", "10002", "10003", "10004", "10005", "10009", "10013", "10044"]

# Display name of a user without name or id.
UNKNOWN_USER = "未知"

# Column names that are identifiers (kept as text), matched case-insensitively.
ID_NAME_PATTERN = r"(id$|_id|_code|_no$|phone|mobile|barcode|batch|sku)"

# A first data row whose first cell contains one of these is a field description.
DESCRIPTION_ROW_MARKERS = ["ID", "唯一"]

# Repeated status headers take the platform of the last anchor column to their left.
STATUS_HEADER_PREFIX = "营业状态"
STATUS_HEADER_ANCHORS = {"京东ID": "京东", "美团ID": "美团", "饿了么ID": "饿了么"}

# Source header -> canonical column name, per dataset.
HEADER_MAPS: dict[str, dict[str, str]] = {
    "bojun_offline_inventory": {
        "店仓": "store_warehouse", "产品编码": "product_code", "款号": "style_no", "品名": "product_name",
        "标准价": "standard_price", "库存数量": "stock_qty", "库存金额": "stock_amount", "箱内库存": "boxed_stock",
        "单件在单": "unit_on_order", "箱内在单": "boxed_on_order", "在单金额": "on_order_amount",
        "在途数量": "in_transit_qty", "在途金额": "in_transit_amount", "冻结量": "frozen_qty",
        "OMS冻结量": "oms_frozen_qty", "预计数量": "expected_qty", "预计金额": "expected_amount",
        "追单可配": "reorder_allocatable", "可配": "allocatable", "ASI": "asi", "可用": "available",
    },
    "jd_store_inventory": {
        "门店编号": "store_code", "门店名称": "store_name", "SKU编码": "sku_code", "商品名称": "product_name",
        "商家商品编号": "merchant_product_code", "条码": "barcode", "销售城市": "sales_city",
        "会员价": "member_price", "门店价格": "store_price", "现货库存": "onhand_stock",
        "实时价": "realtime_price", "可用库存": "available_stock", "商品状态": "product_status",
        "库存状态": "stock_status", "SPU编码": "spu_code", "销售属性名称": "sales_attr_name",
        "指导价": "guide_price", "京东SKU编码": "jd_sku_code",
    },
    "jd_store": {
        "门店编号": "store_code", "门店名称": "store_name", "商家门店编号": "merchant_store_code",
        "小时购门店编号": "hourly_store_code", "商家名称": "merchant_name", "商家编号": "merchant_code",
        "所在城市": "city", "行政区": "district", "营业时间": "business_hours", "门店电话": "store_phone",
        "门店手机": "store_mobile", "门店地址": "store_address", "创建时间": "created_at",
        "更新时间": "updated_at", "最后一次操作人": "last_operator", "营业状态": "business_status",
        "门店状态": "store_status", "小时购营业状态": "hourly_business_status",
        "门店资质": "store_qualification",
        "运力状态（只开通到店团购商家无需关注）": "delivery_capacity_status",
        "秒送门祥链接": "miaosong_store_link", "到家门祥链接": "daojia_store_link",
    },
    "meituan_store": {
        "门店名称": "store_name", "门店ID": "store_id", "内部编码": "internal_code",
        "营业状态": "business_status", "休息/下线原因": "offline_reason", "所在城市": "city",
        "联系电话": "contact_phone", "门店地址": "store_address", "营业时间": "business_hours",
        "配送方式": "delivery_method",
    },
    "meituan_store_inventory": {
        "门店ID": "store_id", "门店名称": "store_name", "省份/城市": "province_city",
        "商品名称": "product_name", "店内码/货号": "internal_sku_code", "sku_id": "sku_id",
        "规格名称": "spec_name", "库存": "stock_qty",
    },
    "feishu_store_mapping": {
        "序号": "seq_no", "省份": "province", "城市": "city", "客户名称": "customer_name",
        "门店名称": "store_name", "内部编码": "internal_code", "备注": "remark", "京东名称": "jd_name",
        "京东ID": "jd_id", "京东营业状态": "jd_business_status", "美团名称": "meituan_name",
        "美团ID": "meituan_id", "美团营业状态": "meituan_business_status", "饿了么名称": "eleme_name",
        "饿了么ID": "eleme_id", "饿了么营业状态": "eleme_business_status",
        "京东启用状态": "jd_enable_status", "验真状态": "verification_status", "门店地址": "store_address",
    },
    "feishu_jd_outlet": {
        "门店编号": "store_code", "门店名称": "store_name", "视频状态": "video_status",
        "门店性质": "store_type", "备注": "remark", "经销商": "dealer",
        "商家门店编号": "merchant_store_code", "小时购门店编号": "hourly_store_code", "所在城市": "city",
        "批次": "batch", "行政区": "district", "门店地址": "store_address", "营业状态": "business_status",
        "门店状态": "store_status", "小时购营业状态": "hourly_business_status", "_blank": "extra_status",
        "匹配表状态": "match_table_status", "验真状态": "verification_status",
    },
    "feishu_meituan_outlet": {
        "门店名称": "store_name", "门店ID": "store_id", "内部编码": "internal_code",
        "营业状态": "business_status", "门店类型": "store_type", "经销商": "dealer",
        "预警情况": "warning_status", "所在城市": "city", "联系电话": "contact_phone",
        "门店地址": "store_address", "营业时间": "business_hours", "配送方式": "delivery_method",
    },
    "feishu_region_contact": {
        "一级经销商": "primary_dealer", "区域": "region", "区域经理": "region_manager",
        "即时零售对接人": "instant_retail_contact",
    },
}

# Columns produced by preprocessing that never count as missing.
OPTIONAL_HEADERS = ["_blank"]

# Edited tables: (canonical name, source header, declared type), required field, key fields.
EDITED_TABLES: dict[str, dict] = {
    "mapping": {
        "table": "feishu_store_mapping",
        "columns": [
            ("seq_no", "序号", "int"), ("province", "省份", "text"), ("city", "城市", "text"),
            ("customer_name", "客户名称", "text"), ("store_name", "门店名称", "text"),
            ("internal_code", "内部编码", "text"), ("remark", "备注", "text"),
            ("jd_name", "京东名称", "text"), ("jd_id", "京东ID", "text"),
            ("jd_business_status", "京东营业状态", "text"), ("meituan_name", "美团名称", "text"),
            ("meituan_id", "美团ID", "text"), ("meituan_business_status", "美团营业状态", "text"),
            ("eleme_name", "饿了么名称", "text"), ("eleme_id", "饿了么ID", "text"),
            ("eleme_business_status", "饿了么营业状态", "text"),
            ("jd_enable_status", "京东启用状态", "float"), ("verification_status", "验真状态", "float"),
            ("store_address", "门店地址", "text"),
        ],
        "editable": ["customer_name", "store_name", "province", "city", "internal_code", "remark",
                     "jd_name", "jd_id", "meituan_name", "meituan_id", "eleme_name", "eleme_id",
                     "store_address"],
        "required": "store_name",
        "key_fields": ["store_name", "customer_name", "jd_id", "meituan_id", "eleme_id"],
    },
    "jd_outlet": {
        "table": "feishu_jd_outlet",
        "columns": [
            ("store_code", "门店编号", "text"), ("store_name", "门店名称", "text"),
            ("video_status", "视频状态", "text"), ("store_type", "门店性质", "text"),
            ("remark", "备注", "text"), ("dealer", "经销商", "text"),
            ("merchant_store_code", "商家门店编号", "text"), ("hourly_store_code", "小时购门店编号", "text"),
            ("city", "所在城市", "text"), ("batch", "批次", "text"), ("district", "行政区", "text"),
            ("store_address", "门店地址", "text"), ("business_status", "营业状态", "text"),
            ("store_status", "门店状态", "text"), ("hourly_business_status", "小时购营业状态", "text"),
            ("extra_status", "网点标注", "text"), ("match_table_status", "匹配表状态", "text"),
            ("verification_status", "验真状态", "text"),
        ],
        "editable": ["store_code", "store_name", "dealer", "store_type", "store_status",
                     "business_status", "city", "district", "store_address", "batch", "remark"],
        "required": "store_name",
        "key_fields": ["store_name", "store_code", "dealer"],
    },
    "mt_outlet": {
        "table": "feishu_meituan_outlet",
        "columns": [
            ("store_name", "门店名称", "text"), ("store_id", "门店ID", "text"),
            ("internal_code", "内部编码", "text"), ("business_status", "营业状态", "text"),
            ("store_type", "门店类型", "text"), ("dealer", "经销商", "text"),
            ("warning_status", "预警情况", "text"), ("city", "所在城市", "text"),
            ("contact_phone", "联系电话", "text"), ("store_address", "门店地址", "text"),
            ("business_hours", "营业时间", "text"), ("delivery_method", "配送方式", "text"),
        ],
        "editable": ["store_id", "store_name", "dealer", "store_type", "business_status", "city",
                     "contact_phone", "store_address", "business_hours", "delivery_method"],
        "required": "store_name",
        "key_fields": ["store_name", "store_id", "dealer"],
    },
}

# Inventory API page: canonical column -> record field names, first non-empty wins.
PAGE_TEXT_FIELDS = {
    "store_code": ["cstoreCode", "cStoreCode"],
    "store_warehouse": ["cstoreName", "cStoreName"],
    "product_code": ["mproductName", "mProductName"],
    "barcode": ["mproductaliasNo", "mProductaliasNo"],
}
PAGE_QTY_FIELDS = {
    "stock_qty": "qty",
    "unit_on_order": "qtypreout",
    "in_transit_qty": "qtyprein",
    "frozen_qty": "qtyFreeze",
    "oms_frozen_qty": "qtyOms",
    "expected_qty": "qtyvalid",
    "reorder_allocatable": "qtyconsign",
    "allocatable": "qtycan",
}
PAGE_OK_CODE = 200

# Load log: a successful run reports "<n> rows"; failure lines mentioning this are skipped.
LOAD_LOG_ROWS_PATTERN = r"(\d+) rows"
LOAD_LOG_SKIP_WORD = "Warning"
LOAD_LOG_MESSAGE_LIMIT = 500

# ---------------------------------------------------------------------------
# FIXED VALUES (end)
# ---------------------------------------------------------------------------

# Dataset keys a load run may select, and the tables each one produces.
DATASET_TABLES = {
    "bojun": ["bojun_offline_inventory"],
    "jd_inventory": ["jd_store_inventory"],
    "jd_store": ["jd_store"],
    "meituan_store": ["meituan_store"],
    "meituan_inventory": ["meituan_store_inventory"],
    "feishu": ["feishu_store_mapping", "feishu_jd_outlet", "feishu_meituan_outlet",
               "feishu_region_contact"],
    "meituan_outlet": ["feishu_meituan_outlet"],
}

# Candidate file names per dataset, preferred first; the export that holds
# store addresses and its two columns.
SOURCE_STEMS = {
    "bojun_offline_inventory": ["伯俊线下库存"],
    "jd_store_inventory": ["京东门店库存-新", "京东门店库存"],
    "jd_store": ["京东门店"],
    "meituan_store": ["美团门店"],
    "meituan_store_inventory": ["美团门店库存"],
    "feishu_store_mapping": ["专卖店"],
    "feishu_jd_outlet": ["京东网点"],
    "feishu_meituan_outlet": ["美团网点"],
    "feishu_region_contact": ["各区域对接人明细"],
}
ADDRESS_STEM = "专卖店详细信息"
ADDRESS_HEADERS = ("店仓名称", "地址")

# The API form of the book inventory has a fixed schema (no inference).
BOOK_API_SCHEMA = (
    "store_code string, store_warehouse string, product_code string, barcode string, "
    "product_name string, stock_qty bigint, unit_on_order bigint, in_transit_qty bigint, "
    "frozen_qty bigint, oms_frozen_qty bigint, expected_qty bigint, "
    "reorder_allocatable bigint, allocatable bigint"
)

STORE_GEO_SCHEMA = (
    "address string, lng double, lat double, adcode string, formatted_address string, "
    "level string, status string, updated_at timestamp"
)

USERS_SCHEMA = (
    "id bigint, open_id string, union_id string, feishu_user_id string, name string, "
    "avatar_url string, email string, mobile string, source string, is_active boolean, "
    "is_admin boolean, first_login_at timestamp, last_login_at timestamp, login_count int, "
    "created_at timestamp, updated_at timestamp"
)

UPLOAD_LOG_SCHEMA = (
    "id bigint, created_at timestamp, label string, filename string, size_bytes bigint, "
    "state string, message string, operator string"
)
