"""Rule tables of the land-use domain, as data; lotsift.operators evaluates them."""

from __future__ import annotations

# Ordered rewrites (pattern, replacement) of a normal text before it is stemmed.
CANON_A = [('^для\\s+', ''),
 ('^ведение\\s+', 'ведение '),
 ('\\bижс\\b', 'индивидуальное жилищное строительство'),
 ('\\bдля индивидуального жилищного строительства\\b', 'индивидуальное жилищное строительство'),
 ('\\bиндивидуальной жилой застройки\\b', 'индивидуальное жилищное строительство'),
 ('\\bиндивидуальной жилищной застройки\\b', 'индивидуальное жилищное строительство'),
 ('\\bдля размещения индивидуального жилого дома\\b', 'размещение индивидуального жилого дома'),
 ('\\bдля размещения жилого дома\\b', 'размещение жилого дома'),
 ('\\bразмещения\\b', 'размещение'),
 ('\\bсадоводства\\b', 'садоводство'),
 ('\\bведения садоводства\\b', 'садоводство'),
 ('\\bдля ведения садоводства\\b', 'садоводство')]

# Ordered rewrites of the conservative form, which the profile rules read.
CANON_B = [('^для\\s+', ''),
 ('^под\\s+', ''),
 ('^по\\s+', ''),
 ('\\bижс\\b', 'индивидуальное жилищное строительство'),
 ('\\bдля индивидуального жилищного строительства\\b', 'индивидуальное жилищное строительство'),
 ('\\bпод строительство индивидуального жилого дома\\b', 'индивидуальное жилищное строительство'),
 ('\\bдля строительства индивидуального жилого дома\\b', 'индивидуальное жилищное строительство'),
 ('\\bпод жилую застройку\\s*индивидуальную\\b', 'индивидуальное жилищное строительство'),
 ('\\bдома индивидуальной жилой застройки\\b', 'индивидуальное жилищное строительство'),
 ('\\bразмещение домов индивидуальной жилой застройки\\b', 'индивидуальное жилищное строительство'),
 ('\\bиндивидуальные жилые дома\\b', 'индивидуальное жилищное строительство'),
 ('\\bземельный участок под жилой дом\\b', 'размещение жилого дома'),
 ('\\bземельные участки под жилой дом\\b', 'размещение жилого дома'),
 ('\\bдля размещения существующего жилого дома\\b', 'размещение жилого дома'),
 ('\\bдля размещения индивидуального жилого дома\\b', 'индивидуальное жилищное строительство'),
 ('\\bдля размещения жилого дома\\b', 'размещение жилого дома'),
 ('\\bпод размещение жилого дома\\b', 'размещение жилого дома'),
 ('\\bпод жилой дом\\b', 'размещение жилого дома'),
 ('\\bпод размещение одноэтажного жилого дома с надворными постройками\\b', 'индивидуальное жилищное строительство'),
 ('\\bдля размещения одноэтажного жилого дома с надворными постройками\\b', 'индивидуальное жилищное строительство'),
 ('\\bпод размещение жилого дома одноэтажного с надворными постройками\\b', 'индивидуальное жилищное строительство'),
 ('\\bмногоквартирные многоэтажные дома\\b', 'многоэтажная жилая застройка'),
 ('\\bразмещения\\b', 'размещение'),
 ('\\bведения садоводства\\b', 'садоводство'),
 ('\\bдля ведения садоводства\\b', 'садоводство'),
 ('\\bдля\\s+ведения\\s+садоводства\\b', 'садоводство'),
 ('\\bсадоводства\\b', 'садоводство'),
 ('\\bдля\\s+ведения\\s+огородничества\\b', 'огородничество'),
 ('\\bведения\\s+огородничества\\b', 'огородничество'),
 ('\\bдля\\s+ведения\\s+личного\\s+подсобного\\s+хозяйства\\b', 'личное подсобное хозяйство'),
 ('\\bразмещение\\s+гаражей\\s+для\\s+собственных\\s+нужд\\b', 'гараж'),
 ('\\bдля\\s+размещения\\s+гаражей\\b', 'гараж'),
 ('\\bдля\\s+размещения\\s+гаража\\b', 'гараж'),
 ('\\bдля\\s+размещения\\s+кирпичного\\s+гаража\\b', 'гараж'),
 ('\\bдля\\s+размещения\\s+трансформаторной\\s+подстанции\\b', 'трансформаторная подстанция'),
 ('\\bразмещение\\s+трансформаторной\\s+подстанции\\b', 'трансформаторная подстанция'),
 ('\\bтп\\b', 'трансформаторная подстанция'),
 ('\\bрп\\b', 'трансформаторная подстанция'),
 ('\\bкнс\\b', 'канализационная насосная станция'),
 ('\\bдля\\s+размещения\\s+существующего\\s+газорегуляторного\\s+пункта\\b', 'газорегуляторный пункт'),
 ('\\bдля\\s+размещения\\s+газорегуляторного\\s+пункта\\b', 'газорегуляторный пункт'),
 ('\\bгазорегуляторного\\s+пункта\\b', 'газорегуляторный пункт'),
 ('\\bгазорегуляторных\\s+пунктов\\b', 'газорегуляторный пункт'),
 ('\\bгрп\\b', 'газорегуляторный пункт'),
 ('\\bгру\\b', 'газорегуляторный пункт'),
 ('\\bдля\\s+размещения\\s+объектов\\s+электроснабжения\\b', 'электроснабжение'),
 ('\\bдля\\s+размещения\\s+объекта\\s+электроснабжения\\b', 'электроснабжение'),
 ('\\bобъектов\\s+электроснабжения\\b', 'электроснабжение'),
 ('\\bобъекта\\s+электроснабжения\\b', 'электроснабжение'),
 ('\\bдля\\s+размещения\\s+подстанций\\b', 'подстанция'),
 ('\\bдля\\s+размещения\\s+существующих\\s+подстанций\\b', 'подстанция'),
 ('\\bподстанций\\b', 'подстанция'),
 ('\\bстанци[яи]\\s+подкачк(?:и)?\\s+воды\\b', 'насосная станция'),
 ('\\bстанци[яи]\\s+подкачк(?:и)?\\b', 'насосная станция'),
 ('\\bподкачк(?:и)?\\s+воды\\b', 'насосная станция'),
 ('\\bстанция\\s+подкачки\\b', 'насосная станция'),
 ('\\bнасосной\\s+подкачки\\b', 'насосная станция'),
 ('\\bуличн\\s+дорожн(?:ая|ой)?\\s+сет(?:ь|и)\\b', 'улично дорожная сеть'),
 ('\\bподсобн(?:ых|ые|ое|ого|ому|ым|ыми)?\\s+сооружен(?:ий|ия|ие|ием|иями)?\\b', 'подсобные сооружения'),
 ('\\bвспомогательн(?:ых|ые|ое|ого|ому|ым|ыми)?\\s+сооружен(?:ий|ия|ие|ием|иями)?\\b', 'вспомогательные сооружения'),
 ('\\bхозяйственн(?:ых|ые|ое|ого|ому|ым|ыми)?\\s+постро(?:ек|йк(?:а|и|е|ой|ами)?)\\b', 'хозяйственные постройки'),
 ('\\bзру\\b', 'электрическая подстанция'),
 ('\\bзтп\\b', 'трансформаторная подстанция'),
 ('\\bктп\\b', 'трансформаторная подстанция'),
 ('\\bтэц\\b', 'котельная теплоснабжение'),
 ('\\bгск\\b', 'гаражный кооператив')]

# Stems that a short description leaves out.
STOP_STEMS = ['земельн',
 'участок',
 'территор',
 'объект',
 'капитальн',
 'строительств',
 'предназнач',
 'цел',
 'такж',
 'включа',
 'содержан',
 'дан',
 'вид',
 'разреш',
 'использован',
 'код',
 'размещен',
 'размеща',
 'границ',
 'населен',
 'пункт',
 'данн',
 'связ',
 'осуществлен',
 'обеспечен',
 'прием',
 'граждан',
 'вопрос',
 'назначен',
 'организац',
 'обслуживан']

# Stems that mark a text that needs a closer look.
HARD_CASES = ['музей[-\\s]?заповед',
 'историко[-\\s]?художествен',
 'дворцово[-\\s]?парков',
 'объект(?:ы|ов)?\\s+культурн(?:ого|ых)?\\s+наслед',
 'историческ',
 'культурн',
 'ансамбл',
 'заповедник',
 'мемориальн']

# Fixed values: (family, weight, pattern on the conservative form); strong counts 100, medium 70, weak 35.
PROFILE_RULES = [('communal_engineering',
  'strong',
  'трансформаторн\\s+подстанц|электрическ\\s+подстанц|\\bподстанц\\b|насосн\\s+станц|станц\\s+подкачк|подкачк\\s+воды|канализационн\\s+насосн\\s+станц|водозабор|водонапорн\\s+башн|котельн|лэп|линия\\s+электропередач|электроснабж|объект\\s+электроснабж|газопровод|газорегуляторн\\s+пункт|\\bгрп\\b|\\bгру\\b|водопровод|очистн\\s+сооружен|сеть\\s+теплоснабж|сеть\\s+водоотведен|сеть\\s+электросвяз|электроснабж|газоснабж|водоснабж|теплоснабж|\\bнасосн\\b|бойлерн|теплоэлектроцентрал'),
 ('street_network',
  'strong',
  'уличн\\s+дорожн|тротуар|пешеходн\\s+переход|проезд|набережн|бульвар|велодорож|автомобильн\\s+дорог|уличн\\s+сеть|\\bдорог\\b'),
 ('household_outbuilding', 'strong', 'подсобн\\s+сооруж|вспомогательн\\s+сооруж|хозяйственн\\s+постро|надворн\\s+постро'),
 ('education_school', 'strong', 'школ|лице|гимнази'),
 ('education_preschool', 'strong', 'детск\\s+сад|ясл'),
 ('education_professional', 'strong', 'техникум|колледж|училищ|вуз|университет|институт|высш\\s+профессиональн|средн\\s+профессиональн'),
 ('education', 'medium', 'образован|просвещен'),
 ('public_admin',
  'strong',
  'налогов|администрац|административн\\s+здан|административн(?![а-я]*\\s+правонаруш)|мфц|загс|суд|прокуратур|полиц|отдел\\s+полици|ведомств|инспекц|государственн|муниципальн'),
 ('defense_security', 'strong', 'воинск|военн|казарм|штаб|гарнизон|полигон|оборон|министерств\\s+обороны|част[ьи]\\s*№'),
 ('social_service', 'medium', 'социальн|дом\\s+престарел|центр\\s+занятост|детск\\s+дом'),
 ('healthcare',
  'strong',
  'поликлиник|больниц|роддом|фельдшер|здравпункт|стоматолог|аптек|женск\\s+консультац|скора[яй]\\s+медицинск|инфекцион|лечебн\\s+корпус'),
 ('sport', 'strong', 'спорт|стадион|бассейн|каток|ледов\\s+арен|скалодром'),
 ('culture',
  'strong',
  'музе|музей\\s*заповедник|заповедник|дворцово[-\\s]*парков|библиотек|театр|кинотеатр|дом\\s+культур|дворец\\s+культур|цирк|зоопарк|памятник|достопримечатель|объект\\s+культурн\\s+наслед'),
 ('public_catering', 'strong', 'кафе|ресторан|столов|бар|булочн'),
 ('retail', 'strong', 'магазин|супермаркет|рынок|торгов|\\bкиоск\\b'),
 ('business', 'medium', 'делов|офис|банк|страхов'),
 ('garage', 'strong', 'гараж|гаражи|автостоянк|стоянк\\b'),
 ('public_land', 'strong', 'общ\\s+пользован|земельн\\s+участк\\s+территор'),
 ('gardening', 'strong', 'садоводств|огородничеств|личн\\s+подсобн\\s+хозяйств|\\bогородн\\b'),
 ('residential_individual',
  'strong',
  'индивидуальн\\s+жилищн\\s+строительств|индивидуальн\\s+жил|индивидуальн\\s+жил\\s+дом|одноэтажн\\s+жил\\s+дом|жилой\\s+дом\\s+одноэтажн|индивидуальн\\s+застройк'),
 ('residential_blocked', 'strong', 'блокированн'),
 ('residential_low', 'strong', 'малоэтажн\\s+многоквартирн|малоэтажн\\s+жил'),
 ('residential_mid', 'strong', 'среднеэтажн\\s+жил|среднеэтажн\\s+застройк'),
 ('residential_high', 'strong', 'многоэтажн\\s+жил|многоквартирн\\s+многоэтажн|высотн\\s+жил'),
 ('residential_multifamily', 'strong', 'многоквартирн|многквартирн|могоквартирн|\\bмкд\\b'),
 ('residential_unspecified', 'weak', 'жил[а-я\\s-]*дом|жил[а-я\\s-]*застройк'),
 ('industrial', 'medium', 'производств|цех|завод|склад|логистик|промышлен|мастерск'),
 ('hotel', 'strong', 'гостиниц|гостев\\s+дом|хостел|мотел'),
 ('recreation', 'medium', 'рекреацион'),
 ('public_safety', 'strong', 'пожарн\\s+депо|пожарн\\s+часть|пожарн\\s+охран|\\bмчс\\b'),
 ('transport', 'medium', 'железнодорож|вокзал|автозаправочн|парковк|остановк|транспорт')]

# For each profile key, (pattern, rank) of catalogue texts that serve it.
PROFILE_PATTERNS = {'communal_engineering': [('коммунальн\\s+обслуживан|предоставлен\\s+коммунальн\\s+услуг|водозабор|очистн|насосн|котельн|трансформаторн|подстанц|линия\\s+электропередач|газопровод|газорегуляторн\\s+пункт|\\bгрп\\b|\\bгру\\b|водопровод|электричеств|газа|воды|тепла|электроснабж|объект\\s+электроснабж|подкачк',
                           100)],
 'street_network': [('общ\\s+пользован|уличн\\s+дорожн|автомобильн\\s+дорог|пешеходн\\s+тротуар|пешеходн\\s+переход|набережн|берегов[а-я]*\\s+полос|бульвар|площад|проезд|велодорож',
                     100)],
 'household_outbuilding': [('подсобн\\s+сооруж|вспомогательн\\s+сооруж|хозяйственн\\s+постро|надворн\\s+постро|гараж', 100)],
 'education_preschool': [('дошкольн|образован|просвещен', 95)],
 'education_school': [('начальн|средн\\s+общ|образован|просвещен', 95)],
 'education_professional': [('профессиональн|высш|образован|просвещен', 95)],
 'education': [('образован|просвещен', 90)],
 'public_admin': [('обществен\\s+управлен', 100), ('делов\\s+управлен', 80), ('административн\\s+здан|административн', 90)],
 'defense_security': [('обеспечен\\s+обороны\\s+и\\s+безопасности|военн|воинск|казарм|штаб|гарнизон|полигон|оборон', 100)],
 'social_service': [('социальн\\s+обслуживан', 100)],
 'healthcare': [('амбулаторн|поликлинич|медицин|стационар|здравоохран', 95)],
 'sport': [('спорт', 100)],
 'culture': [('культурн\\s+развити|культур|музе|театр|библиотек|цирк|зоопарк', 95)],
 'public_catering': [('обществен\\s+питан', 100)],
 'retail': [('магазин|торгов', 95), ('объект\\s+торгов', 90)],
 'business': [('делов\\s+управлен', 100), ('банк|страхов', 95)],
 'garage': [('обслуживан\\s+автотранспорт', 90), ('гараж', 85)],
 'public_land': [('общ\\s+пользован|уличн\\s+дорожн|пешеходн\\s+тротуар|пешеходн\\s+переход|проезд|бульвар|набережн|автомобильн\\s+дорог', 100)],
 'gardening': [('садоводств|огородничеств|личн\\s+подсобн\\s+хозяйств', 100)],
 'residential_individual': [('индивидуальн\\s+жилищн\\s+строительств', 100), ('индивидуальн\\s+жил\\s+дом', 95)],
 'residential_blocked': [('блокированн', 100)],
 'residential_low': [('малоэтажн\\s+многоквартирн', 100)],
 'residential_mid': [('среднеэтажн\\s+жил', 100)],
 'residential_high': [('многоэтажн\\s+жил', 100)],
 'residential_multifamily': [('среднеэтажн\\s+жил', 100),
                             ('многоэтажн\\s+жил', 100),
                             ('многоквартирн(?!\\s*(?:жил|застройк)?\\s*$)', 95),
                             ('жилая\\s+застройка', 80),
                             ('малоэтажн\\s+многоквартирн', 60)],
 'residential_unspecified': [('жил', 60)],
 'industrial': [('производств|склад|промышлен', 95)],
 'transport': [('железнодорожн|автомобильн\\s+транспорт|обслуживан\\s+автотранспорт|транспорт', 95)],
 'hotel': [('гостиничн\\s+обслуживан|гостиниц|средств\\s+размещен|санаторн\\s+деятельност', 100)],
 'recreation': [('рекреаци|отдых|природн|зеленн|парк', 95)],
 'public_safety': [('пожарн|обеспечен\\s+безопасн|охран\\s+порядк', 90), ('коммунальн\\s+обслуживан', 60)]}

# Fixed values: (pattern, pattern that must be absent, phrases to append) on the canonical text.
HINT_RULES = [('административн\\s+здан|административн', None, ['общественное управление', 'деловое управление', 'административное здание', 'офис']),
 ('воинск|военн|казарм|штаб|гарнизон|полигон|оборон|част[ьи]\\s*№',
  None,
  ['обеспечение обороны и безопасности', 'военные объекты', 'воинская часть']),
 ('многоквартирн|многквартирн|могоквартирн|мкд\\b|многоэтажн|среднеэтажн',
  None,
  ['среднеэтажная жилая застройка', 'многоэтажная жилая застройка', 'размещение многоквартирного жилого дома', 'жилая застройка']),
 ('малоэтажн\\s+многоквартирн', None, ['малоэтажная многоквартирная жилая застройка']),
 ('индивидуальн\\s+жил|ижс|индивидуальн\\s+застройк|одна\\s+семь|однокварт', None, ['для индивидуального жилищного строительства']),
 ('жил[а-я\\s-]*дом|под\\s+жил',
  'многоквартирн|многоэтажн|среднеэтажн|блокирован',
  ['для индивидуального жилищного строительства', 'жилая застройка']),
 ('подстанц|трансформатор|\\bтп\\s*№|\\bтп\\s*\\d|\\bтп\\b',
  None,
  ['трансформаторная подстанция',
   'линии электропередач',
   'предоставление коммунальных услуг',
   'коммунальное обслуживание',
   'электричество электроснабжение']),
 ('теплотрасс|теплосет|теплоснабж|теплопровод|тепловая\\s+сеть|тепло[\\s-]?трасс',
  None,
  ['предоставление коммунальных услуг', 'коммунальное обслуживание', 'теплоснабжение тепловые сети', 'инженерная инфраструктура']),
 ('водопровод|водоснабж|канализац|водоотвед|газопровод|газоснабж|очистн\\s+сооруж|насосн\\s+станц|котельн',
  None,
  ['предоставление коммунальных услуг', 'коммунальное обслуживание', 'инженерная коммунальная инфраструктура']),
 ('улиц|переулок|проезд|тротуар|пешеходн|набережн|бульвар|велодорож|автомобильн\\s+дорог|капитальн\\s+ремонт\\s+пер|капитальн\\s+ремонт\\s+ул',
  None,
  ['улично-дорожная сеть', 'размещение автомобильных дорог', 'земельные участки территории общего пользования', 'тротуары пешеходные переходы']),
 ('внутримикрорайон|внутриквартал|внутридворов',
  None,
  ['улично-дорожная сеть', 'земельные участки общего пользования', 'размещение автомобильных дорог']),
 ('гараж', 'служебн|ведомствен|корпоративн|такси', ['размещение гаражей для собственных нужд', 'хранение автотранспорта', 'гараж индивидуальный']),
 ('благоустройств', None, ['благоустройство территории']),
 ('\\bзру\\b|\\bзтп\\b|\\bктп\\b', None, ['трансформаторная подстанция', 'предоставление коммунальных услуг', 'коммунальное обслуживание']),
 ('бойлерн', None, ['котельная', 'предоставление коммунальных услуг', 'коммунальное обслуживание']),
 ('теплоэлектроцентрал|\\bтэц\\b', None, ['теплоснабжение', 'электроснабжение', 'коммунальное обслуживание']),
 ('\\bнасосн\\b', 'станц', ['насосная станция', 'предоставление коммунальных услуг', 'коммунальное обслуживание']),
 ('\\bгск\\b|гаражн\\s+кооператив', None, ['хранение автотранспорта гаражи', 'гаражи для личных нужд', 'гараж']),
 ('автостоянк|стоянк\\b|многоярусн',
  'автомобилестроен|производств\\s+автомобил',
  ['хранение автотранспорта', 'парковка стоянка', 'гаражи для личных нужд']),
 ('гостев|гостиниц|хостел|мотел', None, ['гостиничное обслуживание', 'средства размещения', 'гостиница']),
 ('рекреацион', None, ['рекреация отдых', 'природные рекреационные территории', 'зоны отдыха']),
 ('\\bсуд\\b|городск.*суд|районн.*суд|мировой.*суд|арбитражн.*суд', None, ['общественное управление', 'судебная власть', 'административное здание']),
 ('мастерск', None, ['производственная деятельность', 'промышленность']),
 ('\\bдорог\\b', 'автомобильн|железнодорож', ['улично-дорожная сеть', 'размещение автомобильных дорог']),
 ('пожарн', None, ['пожарная безопасность', 'обеспечение безопасности', 'пожарное депо']),
 ('\\bпорт\\b|причал|ковш|жбф', None, ['водный транспорт', 'порт', 'причальные сооружения']),
 ('\\bогородн\\b', 'огородничеств', ['ведение огородничества', 'огородный земельный участок']),
 ('инфекцион|лечебн\\s+корпус', None, ['здравоохранение', 'амбулаторное лечение', 'стационарное лечение']),
 ('\\bкиоск\\b', 'кафе|буфет', ['размещение объектов розничной торговли', 'торговля']),
 ('подпорн\\s+стенк|подпорн\\s+сооруж', None, ['инженерная инфраструктура', 'благоустройство территории'])]

DWELLING_INDICATOR = 'многоквартирн|многквартирн|могоквартирн|\\bмкд\\b|\\bжил[а-я]*\\s+дом|\\bжил[а-я]*\\s+застройк|\\bжил[а-я]*\\s+здан'
TYPE_QUALIFIER = 'малоэтажн|среднеэтажн|многоэтажн|высотн|блокиров|секционн|таунхаус|индивидуальн|одноэтажн|двухэтажн|трехэтажн'
NON_DWELLING_GUARD = 'обслуживан|коммунальн|социальн|подсобн\\s+хозяйств'

# Use code of each type of physical object (type id: name, code); the banded type takes its code from its floors.
TYPE_CODES = {4: ('Жилой дом', None),
 5: ('Нежилое здание', None),
 8: ('Автозаправочная станция', '4.9.1'),
 29: ('Склад', '6.9'),
 43: ('Промышленная территория', '6.0'),
 49: ('Полигон ТБО', '12.2'),
 13: ('Распределительный трубопровод для транспортировки газа', '3.1.1'),
 14: ('Электрическая подстанция', '3.1.1'),
 18: ('Объект магистрального газопровода', '3.1.1'),
 20: ('Линия электропередачи', '3.1.1'),
 21: ('Электростанция', '3.1.1'),
 24: ('Сеть водоотведения', '3.1.1'),
 27: ('Сеть водоснабжения', '3.1.1'),
 33: ('Возобновляемый источник энергии', '3.1.1'),
 34: ('Гидроэлектростанция', '3.1.1'),
 35: ('Атомная электростанция', '3.1.1'),
 38: ('Водонапорная башня', '3.1.1'),
 39: ('Водоочистное сооружение', '3.1.1'),
 40: ('Водозаборное сооружение', '3.1.1'),
 41: ('Котельная', '3.1.1'),
 42: ('Насосная станция', '3.1.1'),
 53: ('Сеть электросвязи', '3.1.1'),
 56: ('Объект теплоснабжения', '3.1.1'),
 57: ('Объект связи', '3.2.3'),
 58: ('Сеть теплоснабжения', '3.1.1'),
 59: ('Объект добычи и транспортировки газа', '3.1.1'),
 10: ('Остановка наземного общественного транспорта', '7.2.1'),
 19: ('Парковка', '2.7.1'),
 28: ('Порт', '7.3'),
 30: ('Железнодорожная станция', '7.1'),
 50: ('Федеральная дорога', '7.2'),
 51: ('Региональная дорога', '7.2'),
 52: ('Местная дорога', '7.2'),
 61: ('Аэропорт', '7.4'),
 62: ('Железная дорога', '7.1'),
 1: ('Рекреационная зона', '5.0'),
 11: ('Кладбище', '12.1'),
 23: ('Зоопарк', '3.6.3'),
 31: ('Пляж', '5.1.5'),
 36: ('Парк развлечений', '3.6.2'),
 9: ('Памятник', '9.3'),
 46: ('Необрабатываемое поле', '1.0'),
 60: ('Обрабатываемое поле', '1.0'),
 3: ('Зеленая зона', None),
 47: ('Травяное покрытие', None),
 48: ('Лес', '10.1'),
 7: ('Площадка', None),
 63: ('Закрытая территория', None),
 2: ('Водный объект', None),
 44: ('Река', None),
 45: ('Озеро', None),
 54: ('Море', None),
 55: ('Залив', None)}
BANDED_TYPE = 4
# (most floors, code, name), in order; without a number of floors the fallback holds.
FLOOR_BANDS = [(4, '2.1.1', 'Малоэтажная многоквартирная жилая застройка'),
 (8, '2.5', 'Среднеэтажная жилая застройка'),
 (None, '2.6', 'Многоэтажная жилая застройка (высотная застройка)')]
FLOOR_FALLBACK = "2.1"

# Intents of zone and object texts, in order, and what links and blocks them.
INTENTS = {
    "historical_park": [
        r"историческ(?:ий|ого|ая|ие|их)?\s+парк(?:и|ов)?\b", r"дворцово?[-\s]?парков", r"музей[-\s]?заповедник",
        r"историко[-\s]?культурн(?:ая|ой)\s+деятельност", r"объект(?:ы|ов)?\s+культурн(?:ого|ых)?\s+наслед",
    ],
    "recreation_public": [r"территор(?:ия|ии)\s+общ\s+пользован", r"парк(?:и|ов)?\b", "сквер", "рекреаци"],
    "industrial": ["промышлен", "производств", "склад"],
    "residential_individual": ["ижс", r"индивидуальн(?:ое|ой)\s+жилищн", r"индивидуальн(?:ая|ой)\s+жил"],
    "residential_blocked": ["блокированн"],
    "residential_low": ["малоэтажн"],
    "residential_mid": ["среднеэтажн"],
    "residential_high": ["многоэтажн", "высотн"],
    "residential_unspecified": ["жил(?:ая|ой|ого)?", r"жил(?:ая|ой)?\s+застройк"],
}
PROFILE_INTENTS = {"industrial": "industrial", "public_land": "recreation_public", "culture": "historical_park"}
BRIDGE_BLOCKS = [
    r"без\s+вновь\s+возводим(?:ых|ого)?\s+окс", r"без\s+размещени[яй]\s+нов(?:ых|ого)\s+объект", r"запреща(?:ет|ется)\s+нов(?:ое|ые)\s+строительств",
]
BRIDGE_EQUIVALENT = {"historical_park", "recreation_public"}

# Families whose descriptions cover a use directly: what the use's text and an item's text must have, and codes that come first.
COVERAGE = {
    "communal_engineering": {
        "query": r"трансформаторн|подстанц|лэп|линия\s+электропередач|газопровод|газорегуляторн\s+пункт|\bгрп\b|\bгру\b|водопровод|котельн|очистн|насосн|станц\s+подкачк|подкачк\s+воды|электроснабж|объект\s+электроснабж|газоснабж|водоснабж|теплоснабж",
        "item": r"коммунальн\s+обслуживан|предоставлен\s+коммунальн\s+услуг|водозабор|очистн|насосн|котельн|трансформаторн|подстанц|линия\s+электропередач|газопровод|газорегуляторн\s+пункт|водопровод|электричеств|газа|воды|тепла|электроснабж|газоснабж|водоснабж|теплоснабж|подкачк",
        "codes": ["3.1", "3.1.1", "3.1.2"],
    },
    "street_network": {
        "query": r"уличн\s+дорожн|тротуар|пешеходн\s+переход|проезд|набережн|бульвар|велодорож|автомобильн\s+дорог",
        "item": r"земельн\s+участк.*общ\s+пользован|общ\s+пользован|уличн\s+дорожн|автомобильн\s+дорог|пешеходн\s+тротуар|пешеходн\s+переход|набережн|берегов[а-я]*\s+полос|бульвар|площад|проезд|велодорож",
        "codes": ["12.0", "12.0.1", "7.2", "7.2.1"],
    },
    "household_outbuilding": {
        "query": r"подсобн\s+сооруж|вспомогательн\s+сооруж|хозяйственн\s+постро|надворн\s+постро",
        "item": r"подсобн\s+сооруж|вспомогательн\s+сооруж|хозяйственн\s+постро|надворн\s+постро|гараж",
        "codes": ["2.1", "2.2", "2.3", "2.1.1", "13.2", "2.7.2"],
    },
}
# Words of a zone's text that link the equivalent intents.
BRIDGE_HINTS = ["историческ", "культурн", "парк", "сквер", "рекреаци", r"общ\s+пользован"]
