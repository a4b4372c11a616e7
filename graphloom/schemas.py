"""Explicit schemas of every table the engine reads or writes; nothing is inferred."""

MEMBER = "struct<name:string,type_name:string,description:string,is_static:boolean>"
NODES = (
    "seq bigint, id string, name string, namespace string, origin string, category string, title string, summary string, "
    f"icon string, grp string, file_path string, is_abstract boolean, is_static boolean, properties array<{MEMBER}>, methods array<{MEMBER}>"
)
EDGES = "seq bigint, src string, dst string, kind string, details string, line_number int"
GRAPH_JSON = (
    "nodes array<struct<id:string,file:string,namespace:string>>, "
    "links array<struct<source:string,target:string,type:string,details:string>>"
)
_DOC = "Documentation:struct<Summary:string>"
_PARAM = "struct<Name:string,ParameterType:string>"
API_JSON = (
    "Types array<struct<FullName:string,Name:string,BaseType:string,DeclaringType:string,IsInterface:boolean,IsEnum:boolean,"
    f"{_DOC},Fields:array<struct<Name:string,FieldType:string,IsPublic:boolean,IsStatic:boolean,{_DOC}>>,"
    f"Properties:array<struct<Name:string,PropertyType:string,IsPublic:boolean,IsStatic:boolean,{_DOC}>>,"
    f"Methods:array<struct<Name:string,ReturnType:string,IsPublic:boolean,IsStatic:boolean,IsExtension:boolean,{_DOC},Parameters:array<{_PARAM}>>>>>"
)
CHUNKS = "numeric_id bigint, id string, fqn string, type string, text string, embedding array<float>"
