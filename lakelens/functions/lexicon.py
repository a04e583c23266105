"""Own vocabulary: synonyms, canonical terms, abbreviations and domains.

Every term belongs to exactly one family, so a canonical form is unique; families and domains share one ontology.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

# Canonical term -> words that people and column names use for it.
FAMILIES = {
    # trade
    "revenue": "sales turnover takings proceeds receipts billings income 销售额 收入",
    "profit": "margin earnings gain surplus 利润",
    "price": "cost fare fee tariff charge rate amount quote 价格 单价",
    "expense": "expenditure spending outlay overhead 费用",
    "quantity": "qty units volume pieces 数量",
    "discount": "rebate markdown reduction 折扣",
    "tax": "vat duty levy 税",
    "balance": "acctbal account_balance credit 余额",
    "payment": "remittance instalment settlement 付款",
    "invoice": "bill receipt 发票",
    "order": "purchase booking requisition 订单",
    "shipment": "delivery consignment dispatch freight 发货",
    "inventory": "stock warehouse_stock holdings 库存",
    "customer": "client buyer shopper custkey patron 客户",
    "supplier": "vendor seller provider suppkey 供应商",
    "product": "item goods part sku article merchandise partkey 产品",
    "brand": "make marque label 品牌",
    "category": "kind class segment type genre 类别",
    "priority": "urgency importance precedence 优先级",
    "status": "state condition flag stage 状态",
    "return": "refund sendback 退货",
    "budget": "allocation appropriation 预算",
    "currency": "denomination tender 货币",
    "contract": "agreement deal covenant 合同",
    # place and time
    "region": "area zone territory district province 地区 区域",
    "country": "nation homeland land 国家",
    "city": "town metropolis municipality 城市",
    "address": "street location residence 地址",
    "postcode": "zip zipcode postal 邮编",
    "latitude": "lat northing 纬度",
    "longitude": "lon lng easting 经度",
    "altitude": "elevation height_above_sea 海拔",
    "date": "day timestamp when 日期",
    "year": "annum yr 年份",
    "month": "mon calendar_month 月份",
    "week": "wk 星期",
    "hour": "hr clock 小时",
    "duration": "minutes elapsed runtime 时长",
    "deadline": "due cutoff expiry 截止",
    # people
    "user": "member visitor account subscriber 用户",
    "person": "individual human people 人",
    "name": "title designation 名称",
    "age": "years_old birth_years 年龄",
    "gender": "sex male_female 性别",
    "birthday": "dob birthdate 生日",
    "marriage": "marital spouse 婚姻",
    "child": "children kids dependants 子女",
    "salary": "wage pay remuneration stipend 工资",
    "employee": "staff worker personnel 员工",
    "department": "division team bureau 部门",
    "job": "occupation position profession role 职位",
    "email": "mail inbox 邮箱",
    "phone": "telephone mobile cell 电话",
    "nationality": "citizenship 国籍",
    # learning and health
    "student": "pupil learner 学生",
    "teacher": "instructor tutor lecturer 老师",
    "school": "college university academy 学校",
    "course": "lesson subject module 课程",
    "score": "mark points result grade rating 评分",
    "exam": "test quiz assessment 考试",
    "admission": "enrolment intake acceptance 录取",
    "patient": "case inpatient 病人",
    "disease": "illness diagnosis disorder 疾病",
    "hospital": "clinic ward 医院",
    "doctor": "physician clinician 医生",
    "drug": "medicine medication dose 药物",
    "smoker": "smoking tobacco 吸烟",
    "bmi": "body_mass 体质指数",
    "insurance": "policy coverage premium 保险",
    "claim": "indemnity 理赔",
    # machines, energy, environment
    "temperature": "temp heat celsius fahrenheit 温度",
    "humidity": "moisture dampness 湿度",
    "pressure": "bar pascal 压力",
    "vibration": "shaking oscillation 振动",
    "energy": "power kwh electricity watt load 能耗",
    "fuel": "petrol diesel gasoline 燃料",
    "emission": "co2 exhaust pollution 排放",
    "machine": "device equipment apparatus 设备",
    "sensor": "probe detector gauge 传感器",
    "failure": "breakdown fault outage defect 故障",
    "maintenance": "repair servicing overhaul 维护",
    "efficiency": "yield effectiveness 效率",
    "output": "production throughput 产量",
    "weather": "climate forecast 天气",
    "rain": "precipitation rainfall 降雨",
    "wind": "gust breeze 风",
    "building": "premises facility property 建筑",
    "floor_area": "square_metres sqft footage 面积",
    # motion
    "trip": "ride journey tour 行程",
    "distance": "kilometres mileage miles 距离",
    "speed": "velocity pace 速度",
    "vehicle": "car truck automobile 车辆",
    "traffic": "congestion 交通",
    "flight": "airline departure 航班",
    "passenger": "rider traveller 乘客",
    # measure, text, web
    "size": "dimension extent magnitude 大小",
    "weight": "mass heaviness kilograms 重量",
    "length": "span long 长度",
    "width": "breadth wide 宽度",
    "height": "tallness stature 高度",
    "colour": "color hue shade 颜色",
    "quality": "goodness excellence 质量",
    "count": "number tally total_number 计数",
    "percentage": "share proportion ratio percent 百分比",
    "frequency": "occurrence rate_of 频率",
    "language": "lang tongue idiom 语言",
    "document": "text page paper 文档",
    "source": "origin host site 来源",
    "event": "action activity occurrence_of 事件",
    "session": "visit login 会话",
    "click": "tap press 点击",
    "view": "impression pageview 浏览",
    "comment": "remark note feedback 评论",
    "vector": "embedding representation 向量",
    # food, sport, film
    "alcohol": "abv spirit 酒精",
    "acidity": "ph sourness 酸度",
    "sugar": "sweetness glucose 糖",
    "player": "athlete sportsman 球员",
    "match": "game fixture 比赛",
    "goal": "scored 进球",
    "film": "movie picture 电影",
    "actor": "performer cast 演员",
    "breed": "pedigree race 品种",
}
SHORT = {
    # trade
    "qty": "quantity", "amt": "amount", "cust": "customer", "supp": "supplier", "vend": "vendor", "prod": "product", "mfg": "manufacturing", "mfr": "manufacturer", "inv": "invoice",
    "acct": "account", "bal": "balance", "pmt": "payment", "disc": "discount", "ext": "extended", "ship": "shipment", "dlv": "delivery", "ord": "order", "po": "purchase order",
    "rev": "revenue", "exp": "expense", "bdgt": "budget", "curr": "currency", "mkt": "market", "seg": "segment", "cat": "category", "subcat": "subcategory", "prio": "priority",
    "stk": "stock", "whs": "warehouse", "ret": "return", "comm": "commission", "wt": "weight", "pkg": "package", "cntr": "container",
    # place and time
    "addr": "address", "reg": "region", "nat": "nation", "ctry": "country", "cty": "city", "prov": "province", "lat": "latitude", "lon": "longitude", "lng": "longitude", "elev": "elevation",
    "loc": "location", "dest": "destination", "orig": "origin", "dt": "date", "ts": "timestamp", "yr": "year", "qtr": "quarter", "mo": "month", "mth": "month", "wk": "week", "hr": "hour",
    "min": "minute", "sec": "second", "dur": "duration", "beg": "beginning", "dow": "day of week", "eta": "estimated arrival", "tz": "time zone", "fy": "fiscal year",
    # people
    "emp": "employee", "dept": "department", "mgr": "manager", "org": "organisation", "usr": "user", "pax": "passenger", "dob": "birthday", "fname": "first name", "lname": "last name",
    "sal": "salary", "pos": "position", "tel": "telephone", "fax": "facsimile", "hh": "household", "pop": "population", "edu": "education",
    # learning and health
    "stu": "student", "gpa": "grade point average", "gmat": "admission test score", "pt": "patient", "dx": "diagnosis", "rx": "prescription", "bp": "blood pressure", "hosp": "hospital", "med": "medicine",
    # machines
    "temp": "temperature", "hum": "humidity", "press": "pressure", "vib": "vibration", "rpm": "revolutions per minute", "kw": "kilowatt", "kwh": "kilowatt hours", "mms": "millimetres per second",
    "rul": "remaining useful life", "volt": "voltage", "freq": "frequency", "eff": "efficiency", "maint": "maintenance", "mach": "machine", "sens": "sensor", "dist": "distance", "spd": "speed",
    "vel": "velocity", "acc": "acceleration", "veh": "vehicle", "mpg": "miles per gallon", "bldg": "building", "apt": "apartment", "sqft": "square feet", "fuel_cons": "fuel consumption",
    # measure, text, web
    "avg": "average", "num": "number", "nbr": "number", "cnt": "count", "tot": "total", "max": "maximum", "med_val": "median", "std": "standard deviation", "var": "variance", "pct": "percentage",
    "perc": "percentage", "prob": "probability", "est": "estimate", "idx": "index", "id": "identifier", "cd": "code", "desc": "description", "descr": "description", "txt": "text", "msg": "message",
    "lang": "language", "src": "source", "ref": "reference", "doc": "document", "img": "image", "vid": "video", "cfg": "configuration", "err": "error", "stat": "status", "flg": "flag", "ind": "indicator",
    "val": "value", "typ": "type", "len": "length", "ht": "height", "wdt": "width", "vol": "volume", "sz": "size", "lvl": "level", "grp": "group", "cls": "class", "rk": "rank", "diff": "difference",
    "chg": "change", "prev": "previous", "cur": "current", "tmp": "temporary", "alc": "alcohol", "emb": "embedding", "vec": "vector", "env": "environment", "dev": "device", "app": "application",
}
DOMAINS = {
    "commerce": "order orders customer customers price extendedprice totalprice sales product part parts supplier discount lineitem quantity seller freight invoice",
    "finance": "account acctbal balance loan credit debit transaction budget currency stock invest bank payment",
    "geography": "region nation country city territory regionkey nationkey latitude longitude population",
    "activity": "event events user click view signup purchase session visit",
    "documents": "text document documents lang url html page source passage",
    "machines": "sensor machine temperature vibration pressure coolant failure power reading readings maintenance",
    "energy": "energy electricity kwh building floor heating cooling consumption meter load solar",
    "transport": "trip taxi fare vehicle traffic pickup ride distance flight passenger weather",
    "insurance": "policy policies charges smoker bmi claim premium insurance region children",
    "health": "patient disease diagnosis hospital blood glucose dose heart symptom treatment",
    "education": "gpa gmat admission student applicant school grade mba exam course",
    "sport": "player team match goal season league race driver score club",
    "animals": "cat breed fur eye weight body sleep feline dog species",
    "food": "wine alcohol acidity sugar quality taste ph restaurant recipe calories",
    "people": "employee salary department job age gender marital manager hire staff",
    "vectors": "embedding embeddings vector label labels vec",
}


@lru_cache
def reverse() -> dict[str, str]:
    """Synonym -> canonical term."""
    out = {c: c for c in FAMILIES}
    for canon, words in FAMILIES.items():
        for w in words.split():
            out.setdefault(w, canon)
    return out


def canonical(term: str) -> str:
    t = term.lower().strip()
    return reverse().get(t, reverse().get(SHORT.get(t, t), t))


#: Further sources of synonyms, such as a thesaurus: callables from a term to its words. Failures are passed over.
THESAURI: list[Callable[[str], list[str]]] = []


def synonyms(term: str, top_k: int = 10) -> list[str]:
    """The words of the term's family, its long form if it is short, and what thesauri say; without the term itself."""
    t = term.lower().strip()
    canon = canonical(t)
    words = {canon, *FAMILIES.get(canon, "").split(), *lookup(t)}
    if t in SHORT:
        words.add(SHORT[t])
    for ask in THESAURI:
        try:
            words.update(w.lower().strip() for w in ask(t))
        except Exception:  # noqa: BLE001 - a plug-in may fail in any way
            continue
    return sorted(w for w in words if w and w != t)[:top_k]


def expand(term: str) -> str | None:
    """The long form of an abbreviation, or of the abbreviated parts of a name."""
    t = term.lower().strip()
    if t in SHORT:
        return SHORT[t]
    parts = t.replace("-", "_").split("_")
    full = [SHORT.get(p, p) for p in parts]
    return " ".join(full) if full != parts else None


def lookup(term: str) -> list[str]:
    """Words for a term as it stands, without its blanks, and by any family that names it."""
    t = term.lower().strip()
    for form in (t, t.replace(" ", ""), t.replace(" ", "_")):
        if (canon := reverse().get(form)) is not None:
            return [w for w in [canon, *FAMILIES[canon].split()] if w != form]
    return []


def contract(term: str) -> str | None:
    return next((short for short, full in SHORT.items() if full == term.lower().strip()), None)


def aliases(column: str, more: Callable[[str], list[str]] | None = None) -> list[str]:
    """Names under which people may ask for a column, without the column's own name; ``more`` is a plug-in's contribution."""
    low = column.lower()
    parts = [p for p in low.replace("-", "_").replace(" ", "_").split("_") if p]
    stem = parts[1:] if len(parts) > 1 and len(parts[0]) <= 2 else parts  # c_acctbal -> acctbal
    found = {" ".join(parts), "_".join(stem), " ".join(stem)}
    for p in stem:
        found.update(synonyms(p, 4))
        if full := expand(p):
            found.add(full)
    if more is not None:
        try:
            found.update(a.lower().strip() for a in more(column))
        except Exception:  # noqa: BLE001 - a plug-in may fail in any way
            pass
    return sorted(a for a in found if a and a != low)


def domain_scores(text: str) -> dict[str, float]:
    """Share of each domain's words that occur in the text."""
    words = set(text.lower().replace("_", " ").replace("-", " ").split())
    return {d: len(words & set(k.split())) / len(k.split()) for d, k in DOMAINS.items()}


def domain_of(names: list[str]) -> str:
    scores = domain_scores(" ".join(names))
    best = max(scores, key=scores.get)
    return best if scores[best] > 0 else "general"
