"""Word lists and dimension tables of the board."""

# Fixed values, in their natural order.
ENTITY_STOPWORDS = """招聘 校招 校园招聘 校园 应届生 毕业生 秋招 春招 正式启动 全面启动 提前批 开始 开启 启动 计划 项目
招募 网申 通道 发布 岗位 实习生 实习 全球 面向 邀请函 通知 公告 进行中 报名 宣讲会 双选会 专场 名企 名企优选 名企校招
企业 企业招聘 国企 国企招聘 国防 国防招聘 国防军工 就业信息 重要 官方 2027届 2026届 2028届 2027 2026 2025 2024 届""".split()
WRAP_PREFIXES = "名企校招 名企优选 国防军工 国防招聘 国企招聘 企业招聘 高校招聘 就业信息 就业指导 校园招聘 校招 招聘".split()
WRAP_SUFFIXES = "正式启动 正式开启 正式发布 重磅启动 火热开启 启动 开启".split()
UNWRAP_MIN = 8

# Brand, its parent or -, its aliases.
BRANDS = [
    ("ALIBABA", "", ("阿里巴巴集团", "阿里巴巴", "阿里",)),
    ("ALIYUN", "ALIBABA", ("阿里云智能集团", "阿里云智能事业群", "阿里云智能", "阿里云",)),
    ("TAOTIAN", "ALIBABA", ("淘天集团", "淘天",)),
    ("HEMA", "ALIBABA", ("盒马鲜生", "盒马",)),
    ("CAINIAO", "ALIBABA", ("菜鸟集团", "菜鸟网络", "菜鸟",)),
    ("ELEME", "ALIBABA", ("饿了么",)),
    ("AMAP", "ALIBABA", ("高德地图", "高德",)),
    ("DINGTALK", "ALIBABA", ("钉钉",)),
    ("FLYPIG", "ALIBABA", ("飞猪",)),
    ("YOUKU", "ALIBABA", ("优酷",)),
    ("ALIHEALTH", "ALIBABA", ("阿里健康",)),
    ("INTIME", "ALIBABA", ("银泰商业", "银泰",)),
    ("PINGTOUGE", "ALIBABA", ("平头哥",)),
    ("ANTS", "", ("蚂蚁集团", "蚂蚁金服", "蚂蚁",)),
    ("TENCENT", "", ("腾讯",)),
    ("TENCENT_CLOUD", "TENCENT", ("腾讯云",)),
    ("TENCENT_MUSIC", "TENCENT", ("腾讯音乐",)),
    ("HUAWEI", "", ("华为",)),
    ("HUAWEI_CLOUD", "HUAWEI", ("华为云",)),
    ("HISILICON", "HUAWEI", ("海思",)),
    ("BYTEDANCE", "", ("字节跳动", "字节",)),
    ("DOUYIN", "BYTEDANCE", ("抖音",)),
    ("FEISHU", "BYTEDANCE", ("飞书",)),
    ("VOLCENGINE", "BYTEDANCE", ("火山引擎",)),
    ("TOUTIAO", "BYTEDANCE", ("今日头条",)),
    ("JD", "", ("京东集团", "京东",)),
    ("JD_LOGISTICS", "JD", ("京东物流",)),
    ("JD_HEALTH", "JD", ("京东健康",)),
    ("JD_TECH", "JD", ("京东科技",)),
    ("JD_RETAIL", "JD", ("京东零售",)),
    ("NETEASE", "", ("网易公司", "网易",)),
    ("NETEASE_GAMES", "NETEASE", ("网易游戏", "网易雷火", "网易互娱",)),
    ("NETEASE_MUSIC", "NETEASE", ("网易云音乐",)),
    ("NETEASE_YOUDAO", "NETEASE", ("网易有道",)),
    ("MEITUAN", "", ("美团",)),
    ("DIANPING", "MEITUAN", ("大众点评",)),
    ("BAIDU", "", ("百度",)),
    ("PDD", "", ("拼多多",)),
    ("AVIC", "", ("中国航空工业集团", "航空工业集团", "中航工业", "航空工业",)),
    ("CHENGFEI", "AVIC", ("成飞集团", "成飞",)),
    ("SHENFEI", "AVIC", ("沈飞集团", "沈飞",)),
    ("XIFEI", "AVIC", ("西飞集团", "西飞",)),
    ("HONGDU", "AVIC", ("洪都航空", "洪都",)),
    ("CASC", "", ("中国航天科技集团", "航天科技集团", "中国航天科技", "航天科技",)),
    ("CASC_1", "CASC", ("航天一院", "中国运载火箭技术研究院", "运载火箭技术研究院",)),
    ("CASC_5", "CASC", ("航天五院", "中国空间技术研究院", "空间技术研究院",)),
    ("CASC_8", "CASC", ("航天八院", "上海航天技术研究院",)),
    ("CASC_6", "CASC", ("航天六院",)),
    ("CASC_9", "CASC", ("航天九院",)),
    ("CASC_11", "CASC", ("航天十一院",)),
    ("CASIC", "", ("中国航天科工集团", "航天科工集团", "中国航天科工", "航天科工",)),
    ("CASIC_2", "CASIC", ("航天二院", "科工二院",)),
    ("CASIC_3", "CASIC", ("航天三院", "科工三院",)),
    ("CASIC_4", "CASIC", ("航天四院", "科工四院",)),
    ("ZHIXIN", "CASIC_3", ("航天智信",)),
    ("CETC", "", ("中国电子科技集团", "中国电科集团", "中国电科", "中电科",)),
    ("CETC_14", "CETC", ("中电科十四所", "电科十四所", "十四所",)),
    ("CETC_28", "CETC", ("中电科二十八所", "电科二十八所", "二十八所",)),
    ("CETC_38", "CETC", ("中电科三十八所", "电科三十八所", "三十八所",)),
    ("CETC_55", "CETC", ("中电科五十五所", "电科五十五所", "五十五所",)),
    ("CEC", "", ("中国电子信息产业集团", "中国电子信息", "中国电子",)),
]
STRICT_ROOTS = "ALIBABA AVIC CASC CASIC CETC".split()

# Order is meaning, the first hit counts.
PROVINCES = """北京 天津 河北 山西 内蒙古 辽宁 吉林 黑龙江 上海 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 广西 海南
重庆 四川 贵州 云南 西藏 陕西 甘肃 青海 宁夏 新疆 香港 澳门 台湾""".split()
CITY_PROVINCES = {
    "成都": "四川", "武汉": "湖北", "西安": "陕西", "南京": "江苏", "广州": "广东", "深圳": "广东", "东莞": "广东", "杭州": "浙江",
    "长沙": "湖南", "合肥": "安徽", "天津": "天津", "重庆": "重庆", "沈阳": "辽宁", "大连": "辽宁", "哈尔滨": "黑龙江", "长春": "吉林",
    "青岛": "山东", "济南": "山东", "郑州": "河南", "厦门": "福建", "福州": "福建", "昆明": "云南", "贵阳": "贵州", "兰州": "甘肃",
    "石家庄": "河北", "太原": "山西", "南昌": "江西", "南宁": "广西", "海口": "海南", "西宁": "青海", "银川": "宁夏", "拉萨": "西藏",
    "呼和浩特": "内蒙古", "乌鲁木齐": "新疆", "苏州": "江苏", "无锡": "江苏", "宁波": "浙江", "珠海": "广东", "佛山": "广东",
}
ACCOUNT_PROVINCES = {
    "北大就业": "北京", "北航就业": "北京", "国科大就业": "北京", "人大就业创业": "北京", "成功就业": "北京", "川大就业": "四川", "成电就业": "四川",
    "西安交大就业创业": "陕西", "西电科大就业指导服务中心": "陕西", "西工大就业": "陕西", "浙大就业": "浙江",
}
DEFAULT_CITIES = "成都 西安 北京 上海 深圳 东莞 广州 杭州".split()

# Patterns and markers.
FAIR_TITLE = "宣讲|双选|组团|线下招聘|招聘会"
EMPLOYER_INVITE = "用人单位邀请|致用人单位|企业邀请函|诚邀(各)?(用人)?单位|参会单位邀请|单位邀请函|诚邀企业"
MULTI_COMPANY = "组团|联合|多企业|多单位|双选会|大型招聘会|巡回"
CS_CATEGORY = "计算机|软件|人工智能|大数据|算法|网络安全|开发|IT"
BLOCK_MARKERS = ("当前环境异常", "完成验证后即可继续访问", "此内容因违规", "该内容已被发布者删除")
RESULT_VERSION = 2


def brand_table() -> list[tuple[str, str, list[str]]]:
    """(brand, parent or '', aliases)"""
    return [(b, p, list(names)) for b, p, names in BRANDS]
