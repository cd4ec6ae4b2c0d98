"""Word lists, domains and weights as data.

``KOREAN`` holds the values that the rules of Korean message-phishing detection need; ``ENGLISH``
is a profile for text and pages without Korean. Every rule takes its lists from a profile.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: they must equal these for right results -------------------------------------

TEXT_SHORTENERS = (
    "bit.ly", "tinyurl.com", "is.gd", "goo.gl", "t.co", "ow.ly",
    "buly.kr", "han.gl", "url.kr", "vo.la", "me2.do", "durl.kr",
    "abr.ge", "me2.kr", "muz.so",
)

TEXT_TLDS = (
    "top", "xyz", "click", "link", "info", "online", "yachts",
    "country", "zip", "mov", "gq", "cf", "tk", "ml", "ga", "work",
    "rest", "cyou", "sbs", "quest",
)

KEYWORDS = (
    ("무료", 0.05), ("당첨", 0.10), ("클릭", 0.08), ("조회", 0.06),
    ("인증", 0.08), ("계좌", 0.10), ("송금", 0.12), ("이체", 0.10),
    ("정지", 0.10), ("압류", 0.12), ("체납", 0.10), ("미납", 0.10),
    ("고객센터", 0.05), ("확인요망", 0.10), ("긴급", 0.08), ("즉시", 0.06),
    ("주소불일치", 0.12), ("본인확인", 0.08), ("안내", 0.03), ("환급", 0.08),
)

URL_SHORTENERS = (
    "bit.ly", "t.co", "tinyurl.com", "url.kr", "han.gl", "buly.kr", "vo.la", "c11.kr", "me2.do", "t.ly", "shorturl.at",
)

URL_TLDS = (
    "xyz", "top", "click", "link", "info", "online", "yachts", "work", "rest", "cyou", "site", "art", "buzz", "shop", "cam",
    "one", "life", "boats", "bar", "mom", "cfd", "icu", "sbs", "golf", "hair", "run", "lol", "world", "digital", "loan",
    "homes", "ink", "skin", "makeup", "email",
)

SUSPICIOUS_WORDS = (
    "login", "verify", "secure", "account", "update", "confirm", "password", "bank", "card", "delivery", "parcel", "refund",
    "payment", "auth", "signin", "security", "support", "wallet",
)

OFFICIAL_DOMAINS = (
    "cjlogistics.com", "hanjin.com", "epost.go.kr", "coupang.com", "slx.co.kr", "lotteglogis.com", "ilogen.com", "kdexp.com",
    "ds3211.co.kr", "gspostbox.com",
    "kbcard.com", "shinhancard.com", "samsungcard.com", "hyundaicard.com",
    "kbstar.com", "shinhan.com", "wooribank.com", "kakaobank.com", "toss.im",
    "baemin.com", "11st.co.kr", "gmarket.co.kr",
    "nhis.or.kr", "hometax.go.kr", "koroad.or.kr",
    "tworld.co.kr", "kt.com",
)

MODEL_SHORTENERS = (
    "bit.ly", "me2.do", "han.gl", "url.kr", "buly.kr", "vo.la", "abit.ly", "c11.kr", "muz.so", "tuney.kr", "tinyurl.com",
)

OFFICIAL_NUMBERS = (
    "15881255", "15881300", "15777011", "16002882", "15880011", "15882121", "15889988", "18995368", "15228783", "15771287",
    "15881688", "15447000", "15888700", "15776000", "15889999", "15998000", "15885000", "15993333", "15994905", "16000987",
    "15996001", "15665701", "15771000", "126", "15771120", "114", "100",
)

#: What the model's view of a text takes for a URL.
MODEL_URL = (
    r"(?Ui)(?:https?://[^\s<>\"']+|www\.[^\s<>\"']+|\b(?:[a-zA-Z0-9-]+\.)+"
    r"(?:com|net|org|kr|co\.kr|go\.kr|or\.kr|io|me|im|ly|do|gl|xyz|top|cc|vip|click|buzz|shop)(?:/[^\s<>\"']*)?)"
)

#: What is masked in a text, what is taken out of it as a URL, what may trail a URL, and phone numbers. Texts are
#: cut exactly where these match, so tokens, case keys and class tokens depend on every part of them.
MASK_URL = (
    r"(?U)(?:https?://|www\.)[^\s<>\"']+"
    r"|(?<![@\w.])[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9\-]{1,63})+(?:/[^\s<>\"']*)?"
)
FIND_URL = (
    r"(?Ui)(?:https?://|www\.)[^\s<>\"']+"
    r"|(?<![A-Za-z0-9@])[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9\-]{1,63})+(?::\d{1,5})?(?:/[^\s<>\"']*)?"
)
URL_PARTICLES = "(?:에서|으로|로|은|는|이|가|을|를|와|과|의|에)$"
PHONE = r"(?<!\d)(?:\+\d{1,3}[-\s]?\d{3,4}[-\s]?\d{4}|0\d{1,2}[-\s]?\d{3,4}[-\s]?\d{4}|1\d{3}[-\s]?\d{4}|010[-\s]?\d{3,4}[-\s]?\d{4})(?!\d)"

STOPWORDS = (
    "URL", "발신", "수신", "국외발신", "국내발신", "Web발신", "웹발신", "발송",
    "확인", "조회", "안내", "본인확인", "확인요망", "필요", "요망", "요청",
    "접속", "클릭", "링크", "로그인", "이동", "다운로드", "설치",
    "안내드립니다", "드립니다", "바랍니다", "있습니다", "되었습니다",
    "정지되었습니다", "하세요", "하시기", "합니다", "됩니다", "습니다",
    "주세요", "십시오", "예정입니다",
    "진행하세요", "필요합니다", "신청하세요", "확인하세요", "클릭하세요",
    "계좌가", "고객님이", "귀하의", "고객님", "고객", "님",
    "은행", "카드", "센터", "서비스", "이용", "관련", "대상", "처리", "정보",
)

STRONG_TOKENS = (
    "계좌", "계좌정지", "거래", "거래정지", "출금", "출금정지", "압류", "대출", "환급", "환급금", "환불", "결제", "결제취소",
    "해외결제", "상품권",
    "택배", "배송", "배송조회", "운송장", "주소불일치",
    "개인정보", "정보유출", "명의도용", "본인인증", "인증번호", "보안", "유심", "해킹", "악성앱", "악성코드",
    "사건번호", "보이스피싱", "스미싱", "피싱", "사칭",
    "지원금", "보상금", "정부지원금",
)

#: Particles in the order in which they are tried.
PARTICLES = (
    "으로", "에서", "에게", "한테", "부터", "까지", "보다",
    "을", "를", "이", "가", "은", "는", "의", "에", "로", "와", "과", "도", "만",
)

GENERIC_TOKENS = ("url", "http", "https", "www", "com", "net", "org")

CATEGORIES = (
    ("계좌 정지", ("계좌 정지", "계좌가 정지", "계좌정지", "거래 정지", "거래정지", "이용 정지", "이용정지", "계좌 제한", "계좌제한", "금융거래 제한", "출금 정지", "출금정지")),
    ("본인 인증", ("본인 인증", "본인인증", "본인 확인", "본인확인", "인증 절차", "인증절차", "신원 확인", "신원확인", "인증번호", "본인 여부")),
    ("배송 조회", ("배송 조회", "배송조회", "배송지", "배송 주소", "배송주소", "택배", "운송장", "주소 확인", "주소확인", "배송 확인", "배송확인")),
    ("환급금", ("환급금", "환급", "환불", "피해 환급", "피해환급", "보상금", "지원금", "지원 금액", "정부지원금", "세금 환급", "세금환급")),
    ("결제 취소", ("결제 취소", "결제취소", "승인 취소", "승인취소", "결제 승인", "결제승인", "결제 내역", "결제내역", "카드 승인", "카드승인", "자동 결제", "자동결제")),
    ("개인정보", ("개인정보", "개인 정보", "정보 유출", "정보유출", "개인정보 유출", "개인정보유출", "보안 사고", "보안사고", "해킹", "유출 사고", "유출사고")),
    ("기관 사칭", ("국민은행", "신한은행", "우리은행", "하나은행", "농협", "금융감독원", "검찰", "경찰청", "경찰", "국세청", "정부24", "공공기관", "기관 사칭", "직원 사칭")),
    ("악성 링크 유도", ("링크", "URL", "주소에서", "접속하세요", "접속 바랍니다", "클릭하세요", "바로가기", "홈페이지 접속")),
)

BENIGN_PATTERNS = (
    "정상 승인", "승인되었습니다", "승인 되었습니다", "결제가 완료되었습니다", "결제 완료", "이용금액", "결제금액", "승인금액",
    "입금되었습니다", "입금 되었습니다", "출금되었습니다", "출금 되었습니다", "자동이체", "이용내역",
)

ACTION_PATTERNS = (
    "확인해주세요", "확인해 주세요", "확인 바랍니다", "확인바랍니다", "즉시 확인", "지금 확인", "아래 링크", "아래 주소",
    "링크를", "링크에서", "접속해주세요", "접속해 주세요", "접속 바랍니다", "클릭해주세요", "클릭해 주세요",
    "인증해주세요", "인증해 주세요", "본인인증", "본인 인증", "취소해주세요", "취소해 주세요", "입력해주세요", "입력해 주세요",
    "설치해주세요", "설치해 주세요", "앱 설치", "어플 설치", "송금해주세요", "송금해 주세요", "이체해주세요", "이체해 주세요",
    "연락해주세요", "연락해 주세요", "본인이 아닐 경우", "본인이 아니시면", "본인 거래가 아닐 경우",
    "계좌가 정지", "계좌 정지", "카드가 정지", "카드 정지",
)

ALERT_KEYWORDS = ("피싱", "스미싱", "보이스피싱", "전기통신금융사기", "금융사기", "사칭", "해킹", "악성", "악성앱", "개인정보", "문자 무단발송", "스캠")

TITLE_KEYWORDS = (
    "택배", "배송", "카드", "은행", "금융", "정부", "공공기관", "KISA", "SKT", "유심", "환불", "피해보상", "스미싱", "피싱",
    "보이스피싱", "사칭", "해킹", "악성앱", "개인정보",
)
TITLE_DEFAULT = "피싱주의"

#: Category of an alert: all of the words must be in the title; the first that fits counts.
TITLE_CATEGORIES = (
    (("보이스피싱", "스미싱"), "피싱·스미싱"), (("스미싱",), "스미싱"), (("보이스피싱",), "보이스피싱"), (("피싱",), "피싱"),
    (("사칭",), "사칭 주의"), (("해킹",), "보안 주의"),
)
TITLE_CATEGORY_DEFAULT = "위협 경보"

#: Family of a normal message: any of the words must be in it; the first that fits counts.
FAMILIES = (
    ("hanjin_pickup", ("한진택배", "한진 택배")), ("slx_delivery", ("slx택배", "slx 택배", "[slx")),
    ("korea_post", ("우체국택배", "우체국 택배", "우체국 소포", "epost")), ("coupang", ("쿠팡",)),
)
FAMILY_SPLIT = (("cj대한통운", "cj 대한통운", "cj택배", "cj 택배"), (("cj_complete", ("배송완료", "배달완료")), ("cj_pickup", ("집하", "수거"))), "cj_general")

#: Rewrites of words by which messages try to evade detection, in order.
SPACED = (("계좌", "계 좌"), ("정지", "정 지"), ("인증", "인 증"), ("송금", "송 금"), ("결제", "결 제"), ("확인", "확 인"), ("클릭", "클 릭"), ("설치", "설 치"))
PUNCTUATED = (("계좌", "계·좌"), ("정지", "정-지"), ("인증", "인_증"), ("송금", "송.금"), ("결제", "결/제"), ("확인", "확·인"), ("클릭", "클-릭"), ("설치", "설_치"))
MIXED = (("정지", "정zi"), ("클릭", "click"), ("로그인", "log-in"), ("계좌", "계jwa"), ("확인", "확in"), ("인증", "인jeung"))
SPLIT = (("정지", "정ㅈㅣ"), ("인증", "인ㅈㅡㅇ"), ("계좌", "계ㅈㅘ"), ("송금", "송ㄱㅡㅁ"), ("확인", "확ㅇㅣㄴ"), ("결제", "결ㅈㅔ"))
DOTTED = ((".com", "[.]com"), (".net", "[.]net"), (".org", "[.]org"), (".xyz", "[.]xyz"), (".top", "[.]top"))

#: URLs and phone numbers as the generator of synthetic notices masks them, wider than those above.
GENERATED_URL = r"(?Ui)\b(?:https?://|www\.)[^\s]+|\b(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[^\s]*)?"
GENERATED_PHONE = r"(?U)(?<!\d)(?:\+\d{1,3}[-\s]?)?0?\d{2,3}[-\s]?\d{3,4}[-\s]?\d{4}(?!\d)"

#: What each source's summary says of a {title}, and the advice that follows; "" is any other {source}. Shown as they are, and compared as they are.
SUMMARIES = {
    "KISA": "KISA에서 '{title}' 관련 경보를 안내하고 있습니다. 의심스러운 문자·링크·전화는 즉시 반응하지 말고 공식 기관의 홈페이지나 대표번호를 통해 직접 확인하세요.",
    "경찰청": "경찰청에서 '{title}' 관련 피싱·금융사기 정보를 안내하고 있습니다. 출처가 불분명한 연락이나 링크에는 응답하지 말고 경찰청 또는 해당 기관의 공식 채널을 통해 사실 여부를 확인하세요.",
    "금융감독원": "금융감독원에서 '{title}' 관련 소비자경보를 안내하고 있습니다. 보이스피싱·금융사기가 의심되는 연락에는 응답하지 말고 금융회사나 공식 기관의 대표번호를 통해 직접 확인하세요.",
    "": "{source}에서 '{title}' 관련 안전 정보를 안내하고 있습니다. 의심스러운 연락은 공식 기관의 채널을 통해 직접 확인하세요.",
}

#: Type and sentence of each piece of evidence of the URL rules; {} is its number. They are results, and compared as they are.
URL_EVIDENCE = {
    "ip": ("IP 주소 직접 사용", "도메인 대신 IP 주소가 사용되었습니다."),
    "shortener": ("단축 URL", "실제 접속 주소를 숨길 수 있는 단축 URL입니다."),
    "tld": ("의심 TLD", "피싱 데이터에서 반복적으로 나타난 TLD가 사용되었습니다."),
    "punycode": ("Punycode", "유사 문자 도메인에 사용될 수 있는 Punycode가 포함되었습니다."),
    "at": ("URL 주소 은폐", "@ 문자가 포함되어 실제 접속 도메인을 혼동시킬 수 있습니다."),
    "digits_high": ("도메인 숫자 비율", "도메인 내 숫자 비율이 {}%로 높습니다."),
    "digits": ("도메인 숫자 비율", "도메인 내 숫자 비율이 {}%입니다."),
    "subdomains_many": ("과도한 서브도메인", "서브도메인이 {}개 사용되었습니다."),
    "subdomains": ("다중 서브도메인", "서브도메인이 {}개 사용되었습니다."),
}

#: Why a person should look at a result, in the order in which reasons are tried.
REVIEWS = (
    "최종 위험도가 안전과 위험의 경계 구간에 있습니다.",
    "문자 모델은 높은 위험을 예측했지만 이를 뒷받침하는 규칙·평판·반복 신고 근거가 부족합니다.",
    "문자 모델과 규칙·평판·클러스터 판단이 서로 충돌합니다.",
)

# --- End of fixed values ------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """The lists that rules read; all matching follows the case of the list."""

    text_shorteners: tuple[str, ...] = TEXT_SHORTENERS
    text_tlds: tuple[str, ...] = TEXT_TLDS
    keywords: tuple[tuple[str, float], ...] = KEYWORDS
    url_shorteners: tuple[str, ...] = URL_SHORTENERS
    url_tlds: tuple[str, ...] = URL_TLDS
    url_words: tuple[str, ...] = SUSPICIOUS_WORDS
    official_domains: tuple[str, ...] = OFFICIAL_DOMAINS
    model_shorteners: tuple[str, ...] = MODEL_SHORTENERS
    official_numbers: tuple[str, ...] = OFFICIAL_NUMBERS
    stopwords: tuple[str, ...] = STOPWORDS
    strong_tokens: tuple[str, ...] = STRONG_TOKENS
    particles: tuple[str, ...] = PARTICLES
    generic_tokens: tuple[str, ...] = GENERIC_TOKENS
    categories: tuple[tuple[str, tuple[str, ...]], ...] = CATEGORIES
    benign: tuple[str, ...] = BENIGN_PATTERNS
    actions: tuple[str, ...] = ACTION_PATTERNS
    alert_keywords: tuple[str, ...] = ALERT_KEYWORDS
    title_keywords: tuple[str, ...] = TITLE_KEYWORDS
    title_default: str = TITLE_DEFAULT
    title_categories: tuple[tuple[tuple[str, ...], str], ...] = TITLE_CATEGORIES
    title_category_default: str = TITLE_CATEGORY_DEFAULT
    families: tuple[tuple[str, tuple[str, ...]], ...] = FAMILIES
    family_split: tuple = FAMILY_SPLIT
    rewrites: tuple[tuple[str, tuple[tuple[str, str], ...]], ...] = field(
        default=(("spacing", SPACED), ("special_character", PUNCTUATED), ("english_mix", MIXED), ("url_obfuscation", DOTTED), ("hangul_split", SPLIT))
    )


KOREAN = Profile()

ENGLISH = Profile(
    text_tlds=("net", "org"),
    keywords=(("the", 0.05), ("that", 0.10), ("with", 0.08), ("for", 0.06), ("are", 0.08), ("was", 0.12), ("password", 0.10), ("license", 0.10)),
    url_tlds=("net",),
    url_words=("the", "and", "tion", "ing", "page"),
    stopwords=("the", "of", "and", "to", "in", "is"),
    strong_tokens=("tion", "there", "with", "that", "from", "this", "have", "which", "license", "token", "avec", "nicht", "para"),
    particles=("ing", "ed", "ly", "es", "s"),
    categories=(
        ("connectives", ("with", "from", "avec")), ("articles", ("the ", "der ", "les ")), ("credentials", ("password", "token", "secret")),
        ("licences", ("license", "copyright")), ("contacts", ("@", "mail")), ("negations", ("not ", "nicht", " pas ")),
    ),
    benign=("that", "nicht"),
    actions=("token", "password", "license"),
    alert_keywords=("The", "De", "Er", "On"),
    title_keywords=("the", "ing", "tion", "ent", "que", "sch", "ción"),
    title_default="other",
    title_categories=((("the", "tion"), "both"), (("tion",), "tion"), (("the",), "the")),
    title_category_default="general",
    rewrites=(
        ("spacing", (("the", "t he"), ("with", "wi th"))), ("special_character", (("the", "t-he"), ("tion", "ti.on"))), ("english_mix", (("that", "th4t"), ("for", "f0r"))),
        ("url_obfuscation", DOTTED), ("hangul_split", (("and", "a n d"), ("que", "q u e"))),
    ),
)
