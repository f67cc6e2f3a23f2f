"""Golden programs for the template levels (FIXTURES.md §3)."""
from pyspark.sql import functions as F

from splitcraft.functions import templates as T
from splitcraft.functions.vocab import extract_properties, operators_present

GOLDEN = [
    ('now => ( @org.schema.Restaurant.Restaurant ) filter param:name:String == " blue bolt " => notify',
     "now => ( schema_table ) filter param:property REL_OP VALUE => notify"),
    ('now => ( @org.schema.Restaurant.Restaurant ) filter param:aggregateRating.ratingValue:Number >= 4 and '
     'param:servesCuisine:String =~ " thai " => notify',
     "now => ( schema_table ) filter param:property REL_OP VALUE LOG_OP param:property REL_OP VALUE => notify"),
    ('now => [ param:telephone:String ] of ( ( @org.schema.Hotel.Hotel ) filter param:id:Entity(org.schema.Hotel:Hotel) '
     '== " acme inn " ^^org.schema.Hotel:Hotel ) => notify',
     "now => [ param:property ] of ( ( schema_table ) filter param:property REL_OP VALUE ) => notify"),
    ("now => aggregate count of ( @org.schema.Book.Book ) => notify",
     "now => FUNC_OP of ( schema_table ) => notify"),
    ("now => ( sort param:datePublished:Date desc of ( @org.schema.Book.Book ) ) => notify",
     "now => ( FUNC_OP param:property FUNC_MOD of ( schema_table ) ) => notify"),
    ("now => ( @org.schema.Book.Book ) filter param:datePublished:Date >= new Date ( 2020 , 1 , 1 ) - 3 unit:day => notify",
     "now => ( schema_table ) filter param:property REL_OP VALUE => notify"),
    ("now => ( @org.schema.Movie.Movie ) filter not param:genre:Array(String) contains~ QUOTED_STRING_0 => notify",
     "now => ( schema_table ) filter LOG_OP param:property REL_OP VALUE => notify"),
    ("now => ( @org.schema.Hotel.Hotel ) filter param:priceRange:Enum(cheap,luxury) == enum:cheap or "
     "param:petsAllowed:Boolean == true => notify",
     "now => ( schema_table ) filter param:property REL_OP VALUE LOG_OP param:property REL_OP VALUE => notify"),
    ("now => ( @org.schema.Person.Person ) filter param:homeLocation:Location == location:current_location => notify",
     "now => ( schema_table ) filter param:property REL_OP VALUE => notify"),
]

TYPED = {
    0: "now => ( @org.schema.Restaurant.Restaurant ) filter param:name:String == QUOTED_VAL => notify",
    5: "now => ( @org.schema.Book.Book ) filter param:datePublished:Date >= NUMBER_VAL - NUMBER_VAL => notify",
    7: "now => ( @org.schema.Hotel.Hotel ) filter param:priceRange:Enum(cheap,luxury) == ENUM_VAL or "
       "param:petsAllowed:Boolean == BOOL_VAL => notify",
    8: "now => ( @org.schema.Person.Person ) filter param:homeLocation:Location == LOCATION_VAL => notify",
}
UNTYPED = {
    3: "now => aggregate count of ( schema_table ) => notify",
    6: "now => ( schema_table ) filter not param:property contains~ VALUE => notify",
}
FOLD = [
    ("a >= ( VALUE + VALUE ) and", "a >=  VALUE  and"),
    ("a >= VALUE + VALUE and ( VALUE + VALUE ) b", "a >= VALUE and ( VALUE ) b"),
    ("x ( VALUE + VALUE and y", "x ( VALUE and y"),
    ("x VALUE - VALUE + NUMBER_VAL + VALUE y", "x VALUE y"),
    ("( VALUE + VALUE + VALUE ) z", " VALUE  z"),
    ("x ( ( VALUE + VALUE ) - VALUE ) y", "x  VALUE  y"),
]


def test_abstract_typed_untyped(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(GOLDEN)], "i int, query string")
    rows = df.select("i", T.template_abstract("query").alias("a"), T.template_typed("query").alias("t"),
                     T.template_untyped("query").alias("u")).orderBy("i").collect()
    for r in rows:
        assert r.a == GOLDEN[r.i][1]
        if r.i in TYPED:
            assert r.t == TYPED[r.i]
        if r.i in UNTYPED:
            assert r.u == UNTYPED[r.i]


def test_fold_rounds(spark):
    df = spark.createDataFrame(FOLD, "t string, want string")
    for r in df.select("want", T.fold_value_arithmetic(F.col("t")).alias("got")).collect():
        assert r.got == r.want


def test_null_program_is_nan(spark):
    df = spark.createDataFrame([(None,)], "query string")
    assert df.select(T.template_abstract("query")).first()[0] == "nan"


def test_property_members_keep_delimiters(spark):
    df = spark.createDataFrame([("a tt:x tt:y (tt:z) tt:x ",)], "q string")
    got = df.select(extract_properties("q")).first()[0]
    assert sorted(got) == sorted([" tt:x ", "tt:y ", "(tt:z)"])


def test_operators_need_spaces(spark):
    df = spark.createDataFrame([("a == b and_c not",)], "q string")
    assert df.select(operators_present("q")).first()[0] == ["=="]
