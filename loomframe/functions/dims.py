"""The dimension tables of the item domain, as plain text in their natural order."""

# Fixed values. sRGB to XYZ under D65, and the white point.
SRGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
# Fixed values. Reference sRGB of each named colour; the order breaks ties of nearest().
COLORS = {
    "블랙": (22, 22, 24),
    "화이트": (246, 246, 244),
    "아이보리": (240, 233, 212),
    "그레이": (150, 150, 152),
    "차콜": (66, 66, 70),
    "네이비": (32, 42, 70),
    "블루": (40, 85, 180),
    "스카이블루": (140, 190, 228),
    "베이지": (212, 192, 158),
    "브라운": (112, 72, 42),
    "카키": (108, 108, 68),
    "그린": (40, 120, 64),
    "민트": (160, 220, 200),
    "레드": (200, 32, 42),
    "버건디": (110, 22, 42),
    "핑크": (240, 162, 184),
    "퍼플": (112, 62, 150),
    "옐로우": (240, 210, 52),
    "오렌지": (238, 130, 40),
}
NEUTRALS = ("블랙", "화이트", "아이보리", "그레이", "차콜", "네이비", "베이지", "브라운", "카키")
WHITE_COLORS = ("화이트", "아이보리")
DARK_COLORS = ("블랙", "차콜", "네이비", "버건디", "브라운", "카키", "그린", "레드", "퍼플")
COLOR_GROUPS = ("흰색", "어두운색", "밝은색")

# Fixed values. Wears between washes, by subcategory and by category.
WASH_INTERVAL = {
    "티셔츠": 1, "민소매": 1, "폴로": 1, "트레이닝": 1, "레깅스": 1, "양말": 1,
    "셔츠": 2, "블라우스": 2, "반바지": 2, "원피스": 2,
    "맨투맨": 3, "후드": 3,
    "니트": 4, "슬랙스": 4, "면바지": 4, "치마": 4,
    "가디건": 5, "조끼": 5,
    "청바지": 8,
    "재킷": 10, "블레이저": 10, "점퍼": 10, "바람막이": 10,
    "코트": 30, "패딩": 30,
}
CATEGORY_INTERVAL = {"상의": 2, "하의": 4, "아우터": 10, "원피스": 2, "신발": 20, "가방": 60, "액세서리": 10}
DEFAULT_INTERVAL = 3
CLEAN, WORN, NEEDS_WASH, WASHING = "깨끗함", "착용중", "세탁 필요", "세탁 중"
# Fixed values. Care by material (substring) or subcategory (whole); the first that fits holds.
CARE_RULES = (
    (("가죽", "스웨이드", "모피"), ("코트", "블레이저"), "드라이클리닝", 0),
    (("실크", "레이온"), (), "손세탁", 30),
    (("울", "캐시미어", "니트", "앙고라"), ("니트", "가디건"), "울코스", 30),
)
CARE_DEFAULT = ("일반세탁", 40)
DRY_ONLY = "드라이클리닝"

# Fixed values. Bounds of ease in cm and the labels between them.
FIT_LABELS = ("타이트", "슬림", "레귤러", "세미오버", "오버")
THIGH_LABELS = ("스키니", "슬림", "레귤러", "와이드", "오버와이드")
FIT_BOUNDS = {
    ("상의", "chest"): (5, 10, 16, 24),
    ("원피스", "chest"): (5, 10, 16, 24),
    ("아우터", "chest"): (10, 16, 22, 30),
    ("하의", "hip"): (2, 6, 12, 20),
    ("하의", "thigh"): (3, 8, 14, 22),
}
STRETCH = {"없음": 0, "약간": 2, "많음": 5}
WAIST_BOUNDS, WAIST_LABELS = (0, 3, 6), ("작음", "딱 맞음", "여유", "큼(벨트 필요)")
INSEAM_BOUNDS, INSEAM_LABELS = (-8, -3, 2, 6), ("크롭(발목 위)", "발목", "기본(신발에 살짝 닿음)", "김(롤업 필요)", "바닥에 끌림")
SLEEVE_BOUNDS = (0.25, 0.5, 0.65, 0.9, 1.02, 1.12)
SLEEVE_LABELS = ("짧은 소매", "팔꿈치 위", "팔꿈치", "7부", "손목", "손등을 덮음", "손가락까지 덮음")
LANDMARKS = {"hps": 0.815, "waist": 0.61, "hip": 0.50, "crotch": 0.46, "knee": 0.28, "ankle": 0.05}
LENGTHS = {"arm_length": 0.33, "inseam": 0.45}
# Fixed values. Slack of each fit, weights of an outfit's parts, seasons by temperature.
VOLUME = {"슬림": 0, "레귤러": 1, "세미오버": 2, "오버": 3}
OUTFIT_WEIGHTS = {"color": 0.25, "silhouette": 0.15, "style": 0.15, "formality": 0.15, "freshness": 0.15, "body": 0.15}
SEASONS = ((23, ("여름",)), (17, ("봄", "가을", "여름")), (9, ("봄", "가을")), (None, ("겨울", "가을")))
# Fixed values. Split ranges of the hash bucket 0..99, and bounds of the share bins.
SHARE_BINS = ((0.15, "lt15"), (0.40, "15_40"), (0.70, "40_70"), (None, "ge70"))
LAYERED_SPLITS = {"report": (0, 20), "select": (20, 25), "tune": (25, 30), "train": (30, 100)}
SOLO_SPLITS = {"hidden_report": (0, 25), "hidden_tune": (25, 35), "train": (35, 100)}
# Fixed values. Licence patterns.
ALLOWED_LICENSE, BLOCKED_LICENSE = r"^(cc0|cc[- ]zero|public domain|pd\b|pd-|cc[- ]by(-sa)?[- ]?\d)", r"\b(nc|nd)\b|noncommercial|no ?derivatives"
OPEN_RIGHTS, BLOCKED_RIGHTS = r"publicdomain/(zero|mark)|licenses/by(-sa)?/", r"-nc|-nd|rightsstatements"
