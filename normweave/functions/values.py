"""Word lists, limits, patterns and formats that the data and its readers agree on.

They are stated as they must be for right results; operators take those that vary as parameters.
"""

from __future__ import annotations

# Kinds of records.
MAIN, ADDENDUM, ATTACHMENT, ITEM = "본칙", "부칙", "별표", "항목"
REGULATION_PREFIX = "규정집/"
INSTITUTION = "전남대학교"

# Limits.
MAX_BODY, MAX_ATTACHMENT = 30_000, 60_000
SNIPPET, QUERY_LENGTH, MOST_RESULTS = 200, 500, 20
ROUTE_TOP, ROUTE_TIES = 5, 30
K1, B = 1.5, 0.75
BOOST_NAME, BOOST_TITLE, BOOST_DIVISION = 2.8, 2.0, 1.2
PROFILE_NAME, PROFILE_TITLE, PROFILE_DIVISION, PROFILE_CAP = 3, 2, 1, 6
COVERAGE = 0.4

# Hosts whose https addresses are official, and the parameter that must equal the source key.
SOURCE_HOSTS = {"jnu.ac.kr": "key", "law.go.kr": "schlPubRulSeq"}

STOP_WORDS = [
    "규정", "규칙", "지침", "관련", "문의", "알려줘", "알려주세요", "어떻게", "무엇", "뭐야", "되나요", "있나요",
    "대한", "관한", "경우", "사항", "전남대학교", "어떤", "다른", "필요한가요", "하려면", "절차가", "인가요",
    "언제", "언제까지", "얼마나", "어디", "어디서", "누구", "누가", "하나요", "할까요", "되는지", "가능한가요",
    "알려주실", "궁금합니다", "문의드립니다",
]
#: In the order in which they are tried.
PARTICLES = [
    "으로부터", "에서부터", "에게서", "까지는", "에서는", "으로는", "에게는", "으로", "에서", "에게", "한테", "부터", "까지",
    "처럼", "보다", "이나", "거나", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "만", "로",
]
GENERIC_TERMS = [
    "승인", "신청", "처리", "업무", "관리", "사용", "계약", "구매", "기준", "운영", "규정", "지침", "방법", "대상", "적용",
    "보고", "작성", "제출", "등록", "실시", "절차", "허가", "운용", "지원", "수행", "요청", "확인", "검토", "결정", "시행",
]
PLAIN_GENERIC = ["절차", "업무", "규정", "사용", "처리", "승인", "관련", "유형", "실제"]

ADDENDUM_TITLES = ["시행일", "경과조치", "종전지침 폐지", "재검토기한"]
SUPPLEMENT_TITLES = ["시행일", "경과조치", "종전지침 폐지", "재검토기한", "적용례", "폐지"]

# Clause marks by family; the position in a family is the clause's number.
CLAUSE_MARKS = ["①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳", "➀➁➂➃➄➅➆➇➈➉", "❶❷❸❹❺❻❼❽❾❿", "➊➋➌➍➎➏➐➑➒➓"]

# Text damage: a lost middle dot, a lost clause mark, a lost quotation mark.
DAMAGE_DOT, DAMAGE_MARK, DAMAGE_QUOTE = "가운뎃점_추정", "원문자_추정", "인용부호_추정"

CATEGORY_ALIASES = {
    "INT-01": ["근태", "출퇴근", "병가", "시간외"],
    "INT-02": ["출장비", "교통비", "숙박비", "여비"],
    "INT-03": ["분할", "나눠서 구매", "쪼개서 구매", "소액 구매", "견적", "발주"],
    "INT-04": ["연구과제", "인건비", "참여율", "연구비"],
    "INT-05": ["교부금", "국비", "보조사업", "목적 외 사용"],
    "INT-06": ["기자재", "비품", "자산대장", "불용", "실물"],
    "INT-07": ["개인 정보", "접근 권한", "보안", "외부 전송", "파기"],
    "INT-08": ["외부 특강", "외부 강의", "겸업", "사적 이해", "금품", "향응"],
    "INT-09": ["법인 카드", "클린카드", "영수증", "회계", "예산 집행"],
}

# Listing: keywords by weight, and the areas that each get a quota.
CORE_KEYWORDS = [
    "인사", "교원", "직원", "임용", "복무", "학사", "교무", "교육과정", "수업", "성적", "학적", "연구", "산학", "행정", "총무",
    "학생", "장학", "시설", "안전", "정보화", "정보보안", "데이터", "개인정보", "재무", "회계", "예산", "계약", "구매",
]
CORE_DOMAINS = [
    ["인사", "교원", "직원", "임용", "승진", "복무", "성과급", "겸직"],
    ["학사", "교무", "교육과정", "교과과정", "수업", "성적", "학적", "학점"],
    ["연구", "산학", "실험", "방사선"],
    ["행정", "총무", "공무", "출장", "위원회", "업무처리"],
    ["학생", "장학", "동아리", "생활관"],
    ["시설", "안전", "교통", "관사", "환경"],
    ["정보화", "정보보안", "정보시스템", "데이터", "개인정보", "전산"],
    ["재무", "회계", "예산", "계약", "구매", "등록금", "상품권"],
]

# References: what stands for no rule, what is law, and what only looks like it.
VAGUE = [
    "이", "본", "동", "같은", "그", "위", "해당", "규정", "지침", "이상", "각", "경우", "경우에는", "다만", "때에는", "따라",
    "의하여", "의한", "따른", "관한", "및", "또는", "제외하고는", "포함한", "준용한다", "정한", "정하는", "위하여",
]
NOT_A_RULE = [
    "관련 규정", "관계 규정", "이 규정", "본 규정", "해당 규정", "관련 지침", "이 지침", "관계 법령", "관련 법령", "이 학칙",
    "본 학칙", "제 규정", "각종 규정", "타 규정",
]
NOT_A_LAW_TAIL = ["방법", "기법", "계산법", "수법", "용법", "요법", "문법", "어법", "화법"]
LAW_TAIL_NAMED = ["법", "법률", "시행령", "시행규칙", "령", "규칙", "조례", "특별법", "정관"]
LAW_TAIL_RULE = ["법", "법률", "시행령", "시행규칙", "조례", "특별법"]
KNOWN_LAWS = [
    "고등교육법시행령", "고등교육법", "교육공무원법", "교육공무원임용령", "사립학교법", "개인정보보호법", "개인정보 보호법",
    "국가공무원법", "국가공무원 복무규정", "지방공무원법", "산업교육진흥 및 산학연협력촉진에 관한 법률", "학교보건법",
    "평생교육법", "초·중등교육법시행령", "초·중등교육법", "병역법", "국가연구개발혁신법", "공공기관의 운영에 관한 법률",
    "상법", "근로기준법", "국립대학병원 설치법", "금융산업의 구조개선에 관한 법률", "벤처기업육성에 관한 특별 조치법",
    "중소기업창업 지원법", "중소기업 인력지원 특별법", "지능정보화 기본법",
    "소재ㆍ부품ㆍ장비산업 경쟁력 강화 및 공급망 안정화를 위한 특별조치법", "국가첨단전략산업법",
    "연구실 안전환경 조성에 관한 법률", "원자력안전법", "대학교원 자격기준 등에 관한 규정",
    "회계관계직원 등의 책임에 관한 법률", "국가를 당사자로 하는 계약에 관한 법률",
    "부정청탁 및 금품등 수수의 금지에 관한 법률", "공무원 여비 규정", "공무원 여비규정", "고용보험법", "국민건강보험법",
    "공공감사에 관한 법률", "부패방지 및 국민권익위원회의 설치와 운영에 관한 법률", "공직자의 이해충돌 방지법",
    "공익신고자 보호법", "행정절차법", "민법", "형법",
]
TRAILING_PARTICLES = ["에는", "에서", "에게", "으로", "이나", "이라도", "에", "은", "는", "이", "가", "을", "를", "의", "와", "과", "도", "만", "로"]

# Personal data, in the order in which it is masked: kind and pattern, in the common subset of Java and Python.
PERSONAL = [
    ("주민등록번호", r"(?<!\d)\d{6}\s*[-–—]?\s*[1-8]\d{6}(?!\d)"),
    ("전화번호", r"(?<![\d+])(?:\+\s*82[-.\s]?(?:\(0\)[-.\s]?)?|0082[-.\s]?)\(?(?:10|1[016789]|[2-6]\d?)\)?[-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)|(?<!\d)\(?0(?:1[016789]|2|[3-6]\d)\)?[-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)"),
    ("이메일", r"[0-9A-Za-z._%+-]+@[0-9A-Za-z.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9])"),
    ("계좌번호", r"(?:(?:계좌(?:번호)?|입금|예금주)\s*[:：]?\s*)(?:\d[-.\s]?){8,16}\d|(?<!\d)(?:\d{3,6}-\d{2,6}-\d{4,6}|\d{3}-\d{6}-\d{2})(?!\d)"),
    ("주소", r"(?:서울특별시|부산광역시|대구광역시|인천광역시|광주광역시|대전광역시|울산광역시|세종특별자치시|경기도|강원(?:특별자치)?도|충청[남북]도|전라[남북]도|경상[남북]도|제주특별자치도)\s+[가-힣0-9·]+(?:시|군|구)\s+[가-힣0-9·]+(?:로|길|동|읍|면|리)\s*\d+(?:-\d+)?"),
    ("학번추정", r"(?<!\d)20\d{6,8}(?!\d)"),
]
MASK = "[{} 마스킹]"
