"""Word lists, labels and patterns whose exact content decides results."""

NAME_NOISE = r"[\s㈜주식회사()（）·.,-]+"
PLACEHOLDERS = ("unknown", "none", "na", "정보없음", "미상", "해당없음", "없음", "장소없음", "불명")
FOOD_CODE = "FD6"
RESTAURANT_HINTS = ("음식점", "한식", "중식", "일식", "양식", "분식", "뷔페", "패스트푸드", "간식", "카페", "커피", "제과", "베이커리")
COMPANY_WORDS = ("주식회사", "유한회사", "합자회사", "합명회사")
REGION_PARTS = (
    ("서울", r"서울(?:특별시)?\s+([가-힣]+[구군시])"),
    ("경기", r"경기(?:도)?\s+([가-힣]+[시군구])"),
    ("인천", r"인천(?:광역시)?\s+([가-힣]+[시군구])"),
)

#: Large chains with the spellings that give them away, in the order in which they are tried.
BRANDS = (
    ("스타벅스", ("스타벅스", "starbucks")),
    ("투썸플레이스", ("투썸플레이스", "투썸", "twosome")),
    ("메가커피", ("메가커피", "메가mgc커피", "mega coffee", "megacoffee")),
    ("컴포즈커피", ("컴포즈커피", "컴포즈", "compose coffee")),
    ("파리바게뜨", ("파리바게뜨", "파리바게트", "paris baguette")),
    ("뚜레쥬르", ("뚜레쥬르", "뚜레주르", "tous les jours")),
    ("맥도날드", ("맥도날드", "mcdonald")),
    ("버거킹", ("버거킹", "burger king")),
    ("롯데리아", ("롯데리아", "lotteria")),
    ("써브웨이", ("써브웨이", "서브웨이", "subway")),
    ("이디야커피", ("이디야", "ediya")),
    ("빽다방", ("빽다방", "paik")),
    ("커피빈", ("커피빈", "coffee bean")),
    ("할리스", ("할리스", "hollys")),
    ("배스킨라빈스", ("배스킨라빈스", "베스킨라빈스", "baskin")),
    ("던킨", ("던킨", "dunkin")),
    ("KFC", ("kfc",)),
    ("맘스터치", ("맘스터치", "moms touch")),
    ("BBQ", ("bbq",)),
    ("BHC", ("bhc",)),
    ("교촌치킨", ("교촌", "kyochon")),
    ("네네치킨", ("네네", "nene")),
    ("굽네치킨", ("굽네", "goobne")),
    ("페리카나", ("페리카나", "pelicana")),
    ("아웃백", ("아웃백", "outback")),
    ("빕스", ("빕스", "vips")),
    ("애슐리", ("애슐리", "ashley")),
    ("도미노피자", ("도미노피자", "domino")),
    ("피자헛", ("피자헛", "pizza hut")),
    ("미스터피자", ("미스터피자", "mr pizza")),
    ("본죽", ("본죽", "bonjuk")),
    ("김밥천국", ("김밥천국", "kimbap heaven")),
    ("한솥도시락", ("한솥도시락", "hansot")),
    ("파스쿠찌", ("파스쿠찌", "pasqucci")),
    ("엔제리너스", ("엔제리너스", "angel in us")),
    ("탐앤탐스", ("탐앤탐스", "tom n toms")),
    ("노브랜드버거", ("노브랜드버거", "no brand burger")),
)

#: Ranks: elected ones by region, appointed ones in the order in which they are looked for.
CITY = ("시장", "구청장", "군수", "시의원", "구의원", "군의원")
PROVINCE = ("도지사", "시장", "군수", "도의원", "시의원", "군의원")
ELECTED = {
    "서울특별시": ("시장", "구청장", "시의원", "구의원"),
    **dict.fromkeys(("부산광역시", "대구광역시", "인천광역시", "광주광역시", "대전광역시", "울산광역시"), CITY),
    "세종특별자치시": ("시장", "시의원"),
    **dict.fromkeys(("경기도", "강원특별자치도", "충청북도", "충청남도", "전북특별자치도", "전라남도", "경상북도", "경상남도"), PROVINCE),
    "제주특별자치도": ("도지사", "도의원"),
}
APPOINTED = ("부시장", "부지사", "부군수", "부구청장", "실장", "국장", "본부장", "과장", "팀장", "담당관", "전문위원", "읍장", "면장", "동장", "주무관", "직원", "행정관", "연구사", "지도사")
RANKS = tuple(dict.fromkeys((*APPOINTED, *(r for ranks in ELECTED.values() for r in ranks))))
UNIT_RANKS = ("담당관", "전문위원")
STAFF, LOW_RANK, OTHERS, DEFAULT_DEPARTMENT = "직원", "5급 이하", "외", "서울시본청"
INSTITUTIONS = ("시청", "군청", "구청", "도청", "의회")

#: Region names and short forms, with the name that each leads to.
REGION_ALIASES = {
    "서울특별시": "서울특별시",
    "서울": "서울특별시",
    "부산광역시": "부산광역시",
    "부산": "부산광역시",
    "대구광역시": "대구광역시",
    "대구": "대구광역시",
    "인천광역시": "인천광역시",
    "인천": "인천광역시",
    "광주광역시": "광주광역시",
    "광주": "광주광역시",
    "대전광역시": "대전광역시",
    "대전": "대전광역시",
    "울산광역시": "울산광역시",
    "울산": "울산광역시",
    "세종특별자치시": "세종특별자치시",
    "세종": "세종특별자치시",
    "경기도": "경기도",
    "경기": "경기도",
    "강원특별자치도": "강원특별자치도",
    "강원": "강원특별자치도",
    "강원도": "강원특별자치도",
    "충청북도": "충청북도",
    "충북": "충청북도",
    "충청남도": "충청남도",
    "충남": "충청남도",
    "전라북도": "전라북도",
    "전북": "전라북도",
    "전북특별자치도": "전라북도",
    "전라남도": "전라남도",
    "전남": "전라남도",
    "경상북도": "경상북도",
    "경북": "경상북도",
    "경상남도": "경상남도",
    "경남": "경상남도",
    "제주특별자치도": "제주특별자치도",
    "제주": "제주특별자치도",
}

#: Expenses that were not spent at a place.
NOT_A_PLACE = r"경조사|축의금|조의금|부의금|부조금|화환|격려금"
TOTAL_ROW = r"^\s*(?:합계|총계|\d+(?:\s*건)?|-)\s*$"
PURPOSE_AS_PLACE = r"간담회|정례회|대응|결혼\s*축하|축하금|임직원\s*소통|업무협의|정책협의|주요정책추진|회의|행사|유관(?:\s*기관|\(관련\)\s*기관)"

#: Column heads of expense tables, with the field that each announces.
HEAD_FIELDS = {
    "집행일자": "used_date",
    "집행일": "used_date",
    "사용일자": "used_date",
    "사용일": "used_date",
    "승인일": "used_date",
    "승인일자": "used_date",
    "승인일시": "used_date",
    "사용일시": "used_date",
    "집행일시": "used_date",
    "일시": "used_date",
    "일자": "used_date",
    "일": "used_date",
    "결제일자": "used_date",
    "집행시간": "used_time",
    "사용시간": "used_time",
    "사용시각": "used_time",
    "승인시각": "used_time",
    "승인시간": "used_time",
    "시각": "used_time",
    "시간": "used_time",
    "시": "used_time",
    "부서명": "department_name",
    "부서": "department_name",
    "사용자": "user_text",
    "집행자": "user_text",
    "구분": "user_text",
    "장소": "place_text",
    "사용장소": "place_text",
    "집행장소": "place_text",
    "집행처": "place_text",
    "집행처명": "place_text",
    "사용처": "place_text",
    "가맹점명": "place_text",
    "상호": "place_text",
    "상호명": "place_text",
    "업소명": "place_text",
    "주소": "address_hint",
    "집행처주소": "address_hint",
    "가맹점주소": "address_hint",
    "집행목적": "purpose",
    "사용목적": "purpose",
    "사용내역": "purpose",
    "카드사용내역": "purpose",
    "사용내용": "purpose",
    "집행내역": "purpose",
    "내용": "purpose",
    "내역": "purpose",
    "대상인원수": "party_size",
    "대상인원": "party_size",
    "집행인원": "party_size",
    "참석자": "party_size",
    "인원": "party_size",
    "인원수": "party_size",
    "금액": "amount",
    "집행금액": "amount",
    "집행액": "amount",
    "사용금액": "amount",
    "승인금액": "amount",
    "지출액": "amount",
    "지출금액": "amount",
    "사용액": "amount",
    "결제": "payment_method",
    "결제방법": "payment_method",
    "결재방법": "payment_method",
    "집행방법": "payment_method",
    "사용방법": "payment_method",
    "방법": "payment_method",
    "사용방법및비고": "payment_method",
    "비목": "expense_category",
    "세목": "expense_category",
    "업무추진비종류": "expense_category",
    "제목": "expense_category",
}
FIELDS = tuple(dict.fromkeys(HEAD_FIELDS.values()))
#: What a head may merely begin with, and heads whose meaning depends on others.
HEAD_STARTS = {"purpose": ("집행목적", "사용목적", "집행내역"), "place_text": ("사용장소", "집행장소")}
KIND, USER, SPENDING_KIND = "구분", "사용자", "집행유형"

#: Food categories and their keywords, in order of precedence.
FOOD = {
    "malatang": ("마라", "마라탕", "마라샹궈", "훠궈"),
    "shabu-shabu": ("샤브샤브", "샤부샤부", "샤브", "샤부", "월남쌈샤브", "밀푀유나베", "나베", "hotpot", "shabu"),
    "sushi": ("초밥", "스시", "sushi"),
    "ramen": ("라멘", "라면", "ramen"),
    "bingsu": ("빙수", "설빙"),
    "donkatsu": ("돈까스", "돈가스", "돈카츠", "돈카스", "카츠", "가츠", "가스", "커틀릿", "커틀렛", "cutlet", "katsu", "tonkatsu"),
    "agujjim": ("아구찜", "아귀찜", "아구탕", "아귀탕", "해물찜", "해물탕", "생선찜", "생선탕", "대구뽈찜", "대구탕", "동태탕", "알탕", "매운탕", "꽃게찜", "꽃게탕", "조개찜"),
    "jjukkumi": ("쭈꾸미", "주꾸미", "쭈꾸미볶음", "주꾸미볶음", "낙지", "낙지볶음", "오징어", "오징어볶음", "문어", "문어숙회"),
    "dakgalbi": ("닭갈비", "춘천닭갈비"),
    "jokbal-bossam": ("족발", "보쌈", "보족", "장충동"),
    "gopchang": ("곱창", "막창", "대창", "양대창"),
    "beef-bbq": ("소고기", "소갈비", "한우", "육회", "등심", "불고기", "갈비살", "차돌"),
    "pork-bbq": ("삼겹살", "돼지고기", "돼지", "목살", "갈매기살", "오겹살", "돈육"),
    "sashimi": (" 회", ">회", "생선회", "횟집", "수산", "참치", "광어", "우럭", "연어", "해산물", "해물"),
    "tteokbokki": ("분식", "떡볶이", "튀김", "순대", "김밥", "어묵", "토스트"),
    "chicken": ("치킨", "닭강정", "후라이드", "양념치킨", "통닭", "닭"),
    "pizza": ("피자", "pizza"),
    "pasta": ("양식", "파스타", "이탈리안", "이탈리아", "스테이크", "리조또", "필라프"),
    "burger": ("햄버거", "버거", "burger"),
    "sandwich": ("샌드위치", "샌드위치전문", "sandwich"),
    "salad": ("샐러드", "포케", "poke"),
    "lunch-box": ("도시락", "덮밥", "벤또", "bento"),
    "bakery": ("빵", "베이커리", "제과", "제빵", "bakery", "뚜레쥬르", "파리바게뜨"),
    "dessert": ("디저트", "케이크", "마카롱", "와플", "아이스크림", "도넛", "쿠키", "초콜릿"),
    "cafe": ("카페", "커피", "coffee", "espresso", "브런치", "tea", "티"),
    "vietnamese": ("베트남", "쌀국수", "월남쌈", "반미", "pho", "vietnam"),
    "thai": ("태국", "타이", "팟타이", "똠얌", "쏨땀", "thai"),
    "indian": ("인도", "커리", "카레", "탄두리", "난", "마살라", "india"),
    "mexican": ("멕시칸", "멕시코", "타코", "부리또", "퀘사디아", "나초", "mexican"),
    "chinese": ("중식", "중국", "짜장", "자장", "짬뽕", "탕수육", "양꼬치", "딤섬"),
    "gukbap": ("국밥", "해장국", "설렁탕", "곰탕", "감자탕", "순대국", "순댓국", "탕국"),
    "korean-noodles": ("냉면", "국수", "칼국수", "막국수", "메밀", "우동", "수제비", "소바"),
    "pub": ("술집", "호프", "맥주", "주점", "포차", "이자카야", "bar", "pub"),
    "korean-set-meal": ("한식", "백반", "한정식", "가정식", "집밥", "찌개", "전골", "순두부", "김치", "제육", "오리", "보리밥"),
}
DEFAULT_FOOD = "korean-set-meal"
#: How food categories are shown.
FOOD_LABELS = {
    "korean-set-meal": "Korean Set Meal",
    "shabu-shabu": "Shabu Shabu",
    "gukbap": "Gukbap",
    "korean-noodles": "Korean Noodles",
    "dakgalbi": "Dakgalbi",
    "jokbal-bossam": "Jokbal Bossam",
    "gopchang": "Gopchang",
    "pork-bbq": "Pork BBQ",
    "beef-bbq": "Beef BBQ",
    "donkatsu": "Donkatsu",
    "agujjim": "Agujjim",
    "jjukkumi": "Jjukkumi",
    "sashimi": "Sashimi",
    "sushi": "Sushi",
    "ramen": "Ramen",
    "chinese": "Chinese",
    "malatang": "Malatang",
    "tteokbokki": "Tteokbokki",
    "chicken": "Chicken",
    "pizza": "Pizza",
    "pasta": "Pasta",
    "burger": "Burger",
    "sandwich": "Sandwich",
    "salad": "Salad",
    "lunch-box": "Lunch Box",
    "cafe": "Cafe",
    "bakery": "Bakery",
    "dessert": "Dessert",
    "bingsu": "Bingsu",
    "pub": "Pub",
    "vietnamese": "Vietnamese",
    "thai": "Thai",
    "indian": "Indian",
    "mexican": "Mexican",
}

#: Words that names of places do not hold, and phrases of purposes (over names without blanks).
NON_PLACE_HINTS = ("간담회", "관계자", "현안", "업무", "협의", "협력", "논의", "방문", "민원", "격려", "의견", "추진", "점검", "보고", "워크숍")
PURPOSE_PHRASES = (
    "간담회",
    "관계자",
    "현안",
    "의정",
    "의회",
    "의원",
    "교섭단체",
    "위원회",
    "집행부",
    "공무출장",
    "자료수집",
    "의견수렴",
    "업무추진",
    "업무협의",
    "업무수행",
    "직원격려",
    "격려(?:식비|다과비|간식|만찬|오찬)",
    "(?:식비|다과비|간식구매)$",
    "회의$",
    "(?:논의|협의|추진|점검|민원|정책지원)",
    "예산결산",
    "군정관계자",
    "지역특산품홍보",
)
#: What a model calls its confidence, and what counts without a word of it.
CONFIDENCE_LABELS = {"high": 0.9, "medium": 0.7, "low": 0.4, "높음": 0.9, "중간": 0.7, "보통": 0.7, "낮음": 0.4}
DEFAULT_CONFIDENCE = 0.8
#: How grades are called.
GRADE_LABELS = {"★★★": "최다 방문", "★★": "자주 방문", "★": "일반 방문"}
NEW_LABEL = "신규"
#: Offices under which public works are found on a map, by the work.
WORKS_OFFICES = {
    "상수도": (" 수도사업소", " 상하수도사업소", " 상수도사업소", " 수도과", " 상하수도과"),
    "하수도": (" 하수과", " 상하수도사업소", " 하수도과", " 상하수도과"),
}


def name_before_rank(ranks: tuple[str, ...]) -> str:
    """Groups: name, gap, rank. The bounds of the name and of the rank are fixed values. Java and Python read it alike."""
    longest_first = "|".join(sorted(ranks, key=lambda r: (-len(r), r)))
    return rf"(?<![가-힣a-zA-Z0-9_])([가-힣]{{2,4}})(\s*)({longest_first})(?![가-힣])"

# ---- fixed values: tables that come as a stream of cells ----
ITEM_HEADS = ("사용자", "사용일자", "사용장소", "연번", "금액")
PAYS = ("카드", "현금", "계좌", "이체", "제로페이", "지출")
SPENDING_KINDS = ("기관", "시책", "부서", "의정", "업무", "운영")
PURPOSE_STARTS = (
    "20\\d{2}년", "격려", "간담", "구입", "제공", "업무", "회의", "추진", "홍보", "민원", "현안", "협의",
    "행사", "직원", "근무", "관계자", "행정", "통합", "도정", "본회의", "특별법", "박람회", "경조사",
    "언론", "인터뷰", "착공식", "타운홀", "지방도", "이동간", "수행", "내방객", "오찬", "만찬", "소통",
    "의견", "설명", "방문", "대응", "지원", "간식", "다과", "물품", "지급",
)

# ---- fixed values: how purposes begin in printed tables, in the order in which they are looked for ----
PURPOSE_STARTERS = (
    "의정활동", "직무수행", "의장 직무", "부의장 직무", "의회운영위원장", "기획행정위원장", "복지건설위원장", "의회사무국",
    "의회 현안", "의회 현한", "의정현안", "지역 현안", "지역현안", "의장 수행", "의장실", "의정활동", "의정 주요", "의회 소속직원",
    "교섭단체", "생일", "주말", "노동절", "기획행정위원회", "복지건설위원회", "입법지원", "언론사", "2026년", "2026", "2025년",
    "2025회계연도", "2025", "소관", "의회사무국", "현안업무", "힐링", "지역 현안사항", "의회 현안사항", "원활한 의정활동", "영등포구의회",
    "설 명절", "의원 역량강화", "의정활동 홍보지원", "정월대보름", "당면업무추진", "시정홍보", "지방정부", "문화예술", "체육진흥",
    "기후에너지", "사회경제", "자매도시", "복지사각지대", "광명시", "보건위생",
)
