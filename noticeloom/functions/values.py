"""Fixed values of the notice domain: word lists, labels, limits. Operators take them as parameters."""

SOURCES = [(1, "bizinfo", "기업마당"), (2, "kstartup", "K-Startup"), (3, "mss", "중소벤처기업부"), (4, "mois", "행정안전부"), (5, "msit", "과학기술정보통신부")]
SOURCE_ID = {code: id_ for id_, code, _ in SOURCES}
UNKNOWN_SOURCE = "unknown"
UNKNOWN_SOURCE_LABEL = "출처 정보 없음"

NATIONWIDE, UNKNOWN_REGION = "전국", "미확인"
REGIONS = ["서울", "부산", "대구", "인천", "광주", "대전", "울산", "세종", "경기", "강원", "충북", "충남", "전북", "전남", "경북", "경남", "제주"]
REGION_CODES = {
    "seoul": "서울", "busan": "부산", "daegu": "대구", "incheon": "인천", "gwangju": "광주", "daejeon": "대전", "ulsan": "울산",
    "sejong": "세종", "gyeonggi": "경기", "gangwon": "강원", "chungbuk": "충북", "chungnam": "충남", "jeonbuk": "전북",
    "jeonnam": "전남", "gyeongbuk": "경북", "gyeongnam": "경남", "jeju": "제주",
}

CATEGORY_NAMES = ["창업지원", "소상공인", "금융", "판로", "고용", "기술", "수출", "교육/컨설팅", "시설/디지털전환"]
CATEGORY_KEYWORDS = {
    1: ["창업", "예비창업", "스타트업", "초기기업", "창업기업"],
    2: ["소상공인", "자영업", "전통시장", "골목상권"],
    3: ["융자", "대출", "보증", "자금지원", "이차보전", "정책자금"],
    4: ["판로", "마케팅", "홍보", "입점", "라이브커머스", "브랜딩", "온라인판매"],
    5: ["고용", "인건비", "채용", "일자리", "두루누리", "청년내일"],
    6: ["r&d", "기술개발", "연구개발", "특허", "시제품", "기술혁신"],
    7: ["수출", "해외진출", "글로벌", "해외마케팅", "무역"],
    8: ["교육", "컨설팅", "멘토링", "아카데미", "역량강화"],
    9: ["스마트공장", "스마트상점", "디지털전환", "시설", "장비", "키오스크", "스마트화"],
}
INTEREST_CATEGORIES = {
    "startup_support": 1, "small_business_support": 2, "finance_loan_guarantee": 3, "marketing_sales": 4,
    "employment_labor_cost": 5, "technology_rnd": 6, "export_global": 7, "education_consulting": 8, "facility_digital": 9,
}

AUDIENCES = {
    "business": ["예비창업", "창업", "스타트업", "사업자", "개인사업자", "법인", "중소기업", "소상공인", "자영업", "기업", "수출기업", "기술기업"],
    "worker": ["구직", "취업", "취업준비", "청년", "재직자", "근로자", "직장인", "교육생", "인턴", "일자리", "채용", "직무교육"],
}
BUSINESS_TARGETS = ["사업자", "소상공인", "중소기업", "법인", "창업기업", "자영업"]
WORKER_TARGETS = ["구직자", "취업준비생", "직장인", "근로자", "재직자", "채용"]
BUSINESS_USERS = ["pre_startup", "sole_proprietor", "small_business", "sme"]
WORKER_USER, OTHER_USER = "job_seeker_worker", "other"

#: A ministry's notices are kept if the title has none of the first list and title or summary one of the second.
ADMINISTRATIVE = [
    "입법예고", "행정예고", "훈령", "법령", "인사발령", "공무원 채용", "직원 채용", "채용 공고", "감사결과", "정책연구", "연구용역",
    "용역 입찰", "입찰공고", "계약 공고", "청문", "행정처분", "등록취소", "과태료", "제재", "위원 모집", "위원회 위원", "모니터링단",
    "기자단", "국민참여", "유공 포상", "포상 후보자", "공모전", "설문조사",
]
SUPPORT = [
    "지원사업", "지원계획", "시행계획", "모집공고", "참여기업", "기업 모집", "기업모집", "창업", "소상공인", "중소기업", "수출", "판로",
    "마케팅", "기술개발", "연구개발", "r&d", "스마트공장", "정책자금", "융자", "보증", "바우처", "컨설팅", "교육", "인증", "사업자",
    "주관기관", "수행기관",
]
BUSINESS_BENEFITS = ["소상공인", "중소기업", "창업", "자영업", "기업", "스타트업", "사업자"]

#: Tried in this order on an organization's name.
ORGANIZATION_REGIONS = [
    ("서울", "서울"), ("부산", "부산"), ("대구", "대구"), ("인천", "인천"), ("광주", "광주"), ("대전", "대전"), ("울산", "울산"),
    ("세종", "세종"), ("경기", "경기"), ("강원", "강원"), ("충청북도|충북", "충북"), ("충청남도|충남", "충남"), ("전라북도|전북", "전북"),
    ("전라남도|전남", "전남"), ("경상북도|경북", "경북"), ("경상남도|경남", "경남"), ("제주", "제주"),
]

QUESTION_ENDINGS = ["까", "나요", "가요", "까요", "습니까", "있나요", "되나요", "인가요", "무엇", "왜", "어떻게", "언제", "어디", "누가", "가능"]
ATTACHMENT = "첨부파일"
MINISTRY, SCIENCE_MINISTRY, SCIENCE_SUPPORT = "중소벤처기업부", "과학기술정보통신부", "기술/R&D"
INTEREST_REASON, REGION_REASON, REGION_REVIEW, TARGET_REVIEW = "관심 분야 일치", "지역 일치", "지역 확인 필요", "지원대상 확인 필요"
RECEIVING, STARTS_ON, NO_DEADLINE, CLOSED, CLOSES_TODAY, CLOSES_IN = "접수중", "접수일 · ", "상시/미정", "마감", "오늘 마감", "마감일 - "

MIN_CANONICAL, FUZZY_DICE = 10, 0.86
RETENTION_DAYS, RETRY_HOURS = 2, 24
EMPTY_SHELL, LEGACY_EMPTY, FINAL_ATTEMPT = "empty_shell_200", "본문 없음", 2
DETAIL_BUDGET, MAX_DETAIL_BUDGET = 8, 20
EVENT_TYPES = ["view", "detail", "expert_click"]
TOKEN_LEAST, TOKEN_MOST = 32, 512
