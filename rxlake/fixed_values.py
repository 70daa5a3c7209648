"""Fixed values.

These values must equal the ones the original application uses, or results
differ (column lists, labels inside generated text, null words, keyword list,
message templates).  They are stated plainly and in their natural order.
"""

# --- FIXED VALUES (must match the application being re-expressed) ---------

# Catalogue columns kept by the cleaning pipeline, in output order.
KEEP_COLS = [
    "ITEM_SEQ", "ITEM_NAME", "ENTP_NAME", "CHARTN", "DRUG_SHAPE",
    "COLOR_CLASS1", "COLOR_CLASS2", "PRINT_FRONT", "PRINT_BACK",
    "ETC_OTC_CODE", "ITEM_ENG_NAME", "CLASS_NO",
    "LENG_LONG", "LENG_SHORT", "THICK",
]
# Text columns of the catalogue (missing -> "").
CATALOGUE_TEXT_COLS = [
    "ITEM_NAME", "ENTP_NAME", "CHARTN", "DRUG_SHAPE",
    "COLOR_CLASS1", "COLOR_CLASS2", "PRINT_FRONT", "PRINT_BACK",
    "ETC_OTC_CODE", "ITEM_ENG_NAME", "CLASS_NO",
]
# Numeric columns of the catalogue (bad or missing -> 0.0).
CATALOGUE_NUM_COLS = ["LENG_LONG", "LENG_SHORT", "THICK"]

# Serving table `medicines`: target column <- catalogue column.
MEDICINES_COL_MAP = {
    "item_seq": "ITEM_SEQ", "item_name": "ITEM_NAME", "entp_name": "ENTP_NAME",
    "chartn": "CHARTN", "drug_shape": "DRUG_SHAPE", "color_class1": "COLOR_CLASS1",
    "color_class2": "COLOR_CLASS2", "print_front": "PRINT_FRONT", "print_back": "PRINT_BACK",
    "etc_otc_code": "ETC_OTC_CODE", "item_eng_name": "ITEM_ENG_NAME", "class_no": "CLASS_NO",
    "leng_long": "LENG_LONG", "leng_short": "LENG_SHORT", "thick": "THICK",
}
MEDICINES_CONST_COLS = ["item_image", "edi_code"]

# Catalogue document labels (name first, then these parts joined by " | ").
CAT_DOC_SEP = " | "
CAT_LABEL_COMPANY = "제조사: "
CAT_LABEL_SHAPE = "모양: "
CAT_LABEL_COLOR = "색상: "
CAT_LABEL_PRINT = "각인: "

# Leaflet document labels, in order.
LEAFLET_NAME_LABEL = "약품명: "
LEAFLET_PARTS = [
    ("효능", "효능: "),
    ("사용법", "사용법: "),
    ("경고주의사항", "경고: "),
    ("주의사항", "주의사항: "),
    ("상호작용", "상호작용: "),
    ("부작용", "부작용: "),
    ("보관법", "보관법: "),
]
LEAFLET_MIN_CHARS = 20          # documents must be longer than this
LEAFLET_ID_PREFIX = "easy_"
LEAFLET_SOURCE = "e약은요"
HALF_BUILT_THRESHOLD = 4000     # 0 < rows < this => index is half-built

# Leaflet file columns, by position.
LEAFLET_COLUMNS = [
    "품목일련번호", "제품명", "업체명",
    "효능", "사용법", "경고주의사항", "주의사항",
    "상호작용", "부작용", "보관법",
    "공개일자", "수정일자", "낱알이미지", "사업자번호",
]
LEAFLET_CLEAN_COLS = ["제품명", "업체명", "효능", "사용법", "경고주의사항",
                      "주의사항", "상호작용", "부작용", "보관법"]

# Words that clean_text turns into "" (compared after lower-casing).
NULL_WORDS = ["nan", "none", "-", "해당없음", "해당사항없음"]

# Message gate: a message must contain one of these to get drug context.
DRUG_KEYWORDS = ["약", "정", "캡슐", "처방", "먹", "복용", "부작용", "효능", "효과"]

# Context block written ahead of the lookup hits.
CONTEXT_HEADER = "\n\n[의약품 DB 검색 결과]\n"
CONTEXT_DESC_LABEL = "  설명: "

# Confirmation text of a registered alarm: "{name} 알림이 {time}에 등록되었습니다."
ALARM_MSG_MIDDLE = " 알림이 "
ALARM_MSG_END = "에 등록되었습니다."

# Search depths and limits.
NAME_SEARCH_LIMIT = 5
SHAPE_SEARCH_LIMIT = 10
TOKEN_CONTEXT_HITS = 3
VECTOR_TOP_K = 3
MIN_TOKEN_LEN = 2
PREFIX_LEN = 4
PROMPT_HISTORY = 6
REPORT_HISTORY = 20
EMBED_BATCH = 64

# Safety tables: (table, key, [(output column, input column(s))], strict).
# A tuple of input columns means "first non-empty of these".
SAFETY_TABLES = {
    "dur_elderly_warning": ("품목일련번호", [
        ("품목일련번호", "품목일련번호"), ("품목명", "품목명"), ("업소명", "업소명"),
        ("주성분", "주성분"), ("약효분류", "약효분류"), ("고시일자", "고시일자"),
        ("금기내용", "금기내용"), ("DUR성분코드", "DUR성분코드"),
        ("DUR성분명", ("Dur성분명", "DUR성분명")),
    ], False),
    "dur_age_taboo": ("DUR일련번호", [
        ("DUR일련번호", "DUR일련번호"), ("DUR성분코드", "DUR성분코드"), ("DUR성분명", "DUR성분명"),
        ("금기내용", "금기내용"), ("제형", "제형"), ("연령기준", "연령기준"), ("고시일자", "고시일자"),
    ], True),
    "dur_duration_warning": ("DUR일련번호", [
        ("DUR일련번호", "DUR일련번호"), ("DUR성분코드", "DUR성분코드"), ("DUR성분명", "DUR성분명"),
        ("제형", "제형"), ("최대투여기간", "최대투여기간"), ("고시일자", "고시일자"), ("비고", "비고"),
    ], True),
    "dur_additive_warning": ("DUR일련번호", [
        ("DUR일련번호", "DUR일련번호"), ("DUR성분코드", "DUR성분코드"), ("DUR성분명", "DUR성분명"),
        ("금기내용", "금기내용"), ("비고", "비고"),
    ], True),
}
PILL_TABLE = ("pill_identification", "품목일련번호", [
    ("품목일련번호", "품목일련번호"), ("품목명", "품목명"), ("업소명", "업소명"), ("성상", "성상"),
    ("이미지URL", "큰제품이미지"), ("표시앞", "표시앞"), ("표시뒤", "표시뒤"),
    ("제형", "의약품제형"), ("색상앞", "색상앞"), ("크기장축", "크기장축"), ("크기단축", "크기단축"),
    ("분류번호", "분류번호"), ("분류명", "분류명"), ("전문일반", "전문일반구분"), ("보험코드", "보험코드"),
])
PILL_NAME_COL = "품목명"

# --- end of fixed values ----------------------------------------------------

# Public pandas constant: strings pandas' CSV reader turns into missing values
# by default.  Applied to raw CSV fields only (see README, "NA words").
PANDAS_NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
