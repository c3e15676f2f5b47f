"""Grammars of the source languages over token classes, and the token pairs they permit.

The grammars describe which tokens may stand side by side; nesting and the shape of statements are checked apart.
Where a language ends statements at line ends, a pair across a line end may also be the end of one statement and the
start of the next.
"""

from __future__ import annotations

from functools import lru_cache

from factloom.llm.ebnf import Grammar
from factloom.llm.lexers import CODES, classes

_BINARY = '"+" | "-" | "*" | "/" | "%" | "&" | "|" | "^" | "<" | ">" | "==" | "!=" | "<=" | ">" "=" | "&&" | "||" | "<<" | ">" ">" | ">" ">" ">"'
_ASSIGN = '"=" | "+=" | "-=" | "*=" | "/=" | "%=" | "&=" | "|=" | "^=" | "<<=" | ">" ">" "=" | ">>>="'

SCRIPT = f"""
Program = {{ Stmt }} ;
Stmt = Block | Simple ";" | ";" | "if" "(" Expr ")" Stmt [ "else" Stmt ] | "for" [ "await" ] "(" ForHead ")" Stmt
  | "while" "(" Expr ")" Stmt | "do" Stmt "while" "(" Expr ")" ";"
  | "try" Block ( Catch [ Finally ] | Finally ) | "switch" "(" Expr ")" "{{" {{ Case }} "}}" | id ":" Stmt
  | "with" "(" Expr ")" Stmt | Function | Class | Export ;
Block = "{{" {{ Stmt }} "}}" ;
Catch = "catch" [ "(" Target ")" ] Block ;
Finally = "finally" Block ;
Case = ( "case" Expr | "default" ) ":" {{ Stmt }} ;
ForHead = [ Var | Expr ] ";" [ Expr ] ";" [ Expr ] | [ "var" | "let" | "const" ] Target ( mid | "in" ) Expr ;
Target = Id | cid | ArrayLit | ObjectLit ;
Simple = Var | Expr | "return" [ Expr ] | "throw" Expr | "break" [ id ] | "continue" [ id ] | "debugger" | Import ;
Var = ( "let" | "var" | "const" ) Binding {{ "," Binding }} ;
Binding = cid "=" Expr | ( Id | ArrayLit | ObjectLit ) [ "=" Expr ] | cid ( mid | "in" ) ;
Id = id | pre | mid | "yield" | "await" ;
Import = "import" ( str | Clause mid str [ "with" ObjectLit ] ) ;
Clause = iid [ "," ( Names | Star ) ] | Names | Star ;
Star = "*" mid Id ;
Names = "{{" [ Name {{ "," Name }} [ "," ] ] "}}" ;
Name = ( Id | "default" | str ) [ mid ( Id | "default" | str ) ] ;
Export = "export" ( Var ";" | Function | Class | "default" ( Function | Class | Expr ";" ) | Names [ mid str ] ";" | "*" [ mid Id ] mid str ";" ) ;
Function = [ pre ] "function" [ "*" ] [ Id ] Params Block ;
Params = "(" [ Param {{ "," Param }} [ "," ] ] ")" ;
Param = [ "..." ] ( Id | ArrayLit | ObjectLit ) [ "=" Expr ] ;
Class = {{ Decorator }} "class" [ Id ] [ "extends" Unary ] ClassBody ;
ClassBody = "{{" {{ Member }} "}}" ;
Decorator = "@" key [ Args ] | "@" key {{ "." id }} Args ;
Member = {{ Decorator }} {{ pre }} ( [ "*" ] Key Params Block | Key [ "=" Expr ] ";" | ";" | pre Block ) ;
Key = Id | str | num | "[" Expr "]" | AnyWord ;
AnyWord = "delete" | "default" | "catch" | "finally" | "if" | "for" | "in" | "new" | "return" | "import" | "export" | "with" | "throw" | "null" | "true" | "false" | "typeof" | "void" | "class" | "function" | "continue" | "break" ;
Expr = Unary {{ Op Unary }} ;
Op = {_BINARY} | {_ASSIGN} | "," | "===" | "!==" | "??" | "**" | "**=" | "&&=" | "||=" | "??=" | "in" | "instanceof" | "?" Expr ":" | "=>" ;
Unary = {{ "!" | "-" | "+" | "~" | "typeof" | "void" | "delete" | "await" | "yield" | "++" | "--" | "yield" "*" | pre }} Postfix ;
Postfix = Primary {{ "." Id | "?." ( Id | Args | "[" Expr "]" ) | "[" Expr "]" | Args | str | "++" | "--" }} ;
Primary = Id | num | str | re | "this" | "super" | "null" | "true" | "false" | "(" [ Expr ] ")" | ArrayLit | ObjectLit | Function | Class | Arrow | New | "import" Args | "import" "." id | "new" "." id ;
New = "new" Postfix ;
Arrow = [ pre ] ( Params | Id ) "=>" ( Block | Expr ) ;
Args = "(" [ Arg {{ "," Arg }} [ "," ] ] ")" ;
Arg = [ "..." ] Expr ;
ArrayLit = "[" {{ "," }} [ Arg {{ "," {{ "," }} Arg }} [ "," ] ] "]" ;
ObjectLit = "{{" [ Prop {{ "," Prop }} [ "," ] ] "}}" ;
Prop = Id [ "=" Expr ] | Key ":" Expr | {{ pre }} [ "*" ] Key Params Block | "..." Expr ;
"""

TYPED = """
Type = [ "|" | "&" ] TypeUnary { ( "|" | "&" ) TypeUnary } [ "extends" Type "?" Type ":" Type ] | mid Type ;
TypeUnary = { pre | "typeof" | "new" } TypePrimary { "[" [ Type ] "]" } ;
TypePrimary = Id [ TypeArgs ] { "." Id [ TypeArgs ] } | "void" | "null" | "this" | "true" | "false" | str | num | "-" num | "(" Type ")" | FunType | TypeBody | "[" [ TypeItem { "," TypeItem } [ "," ] ] "]" | "import" "(" str ")" "." Id ;
TypeItem = [ "..." ] [ Id [ "?" ] ":" ] Type [ "?" ] ;
FunType = [ TypeParams ] Params "=>" Type ;
TypeArgs = "<" Type { "," Type } ">" ;
TypeParams = "<" TypeParam { "," TypeParam } [ "," ] ">" ;
TypeParam = { pre | "const" | "in" } ( Id | cid ) [ "extends" Type ] [ "=" Type ] ;
TypeBody = "{" { TypeMember } "}" ;
TypeMember = { pre | "+" pre | "-" pre } ( Key [ "?" | "-" "?" ] [ TypeParams ] [ Params ] [ Colon ] | "[" Id ( ":" Type | "in" Type [ mid Type ] ) "]" [ "?" ] Colon | [ "new" ] [ TypeParams ] Params Colon ) [ ";" | "," ] ;
Colon = ":" Type ;
Binding = cid Colon "=" Expr | ( Id | ArrayLit | ObjectLit ) [ "!" ] Colon [ "=" Expr ] | cid Colon ;
Target = ( Id | cid ) Colon ;
Param = { Decorator } { pre } [ "..." ] ( Id | "this" | ArrayLit | ObjectLit ) [ "?" ] [ Colon ] [ "=" Expr ] ;
Function = [ pre ] "function" [ "*" ] [ Id ] [ TypeParams ] Params [ Colon ] ( Block | ";" ) ;
Class = { pre } "class" [ Id ] [ TypeParams ] [ "extends" Unary [ TypeArgs ] ] [ mid Type { "," Type } ] ClassBody ;
Member = { Decorator } { pre } ( [ "*" ] Key [ "?" ] [ TypeParams ] Params [ Colon ] ( Block | ";" ) | Key [ "?" | "!" ] [ Colon ] [ "=" Expr ] ";" | "[" Id ":" Type "]" Colon ";" ) ;
Arrow = [ pre ] [ TypeParams ] Params [ Colon ] "=>" ( Block | Expr ) ;
Stmt = { pre } ( Interface | Alias ";" | Enum | Namespace | Var ";" ) ;
Export = "export" { pre } ( Interface | Alias ";" | Enum | Namespace | Class | Var ";" | "=" Expr ";" | mid "namespace" ) | "export" pre Names [ mid str ] ";" ;
Interface = pre Id [ TypeParams ] [ "extends" Type { "," Type } ] TypeBody ;
Alias = pre Id [ TypeParams ] "=" Type ;
Enum = [ "const" ] "enum" ( Id | cid ) "{" [ Id [ "=" Expr ] { "," Id [ "=" Expr ] } [ "," ] ] "}" ;
Namespace = pre ( Id { "." Id } | str ) Block ;
Import = "import" iid "=" Expr | "import" pre ( Clause | Id [ "," Names ] ) mid str | "import" pre Id "=" Expr ;
Name = pre ( Id | "default" ) [ mid Id ] ;
Op = mid [ "const" ] Type Tail ;
Tail = Op Unary | ")" | ";" | "," | "]" | "}" ;
Postfix = Primary { "!" | TypeArgs Args | TypeArgs str } ;
Unary = "<" Type ">" Unary ;
New = "new" Postfix TypeArgs ( Args | ";" ) ;
"""

JAVA = f"""
Program = [ {{ Annotation }} "package" Path ";" ] {{ "import" [ "static" ] Path [ "." "*" ] ";" | ";" }} {{ TypeDecl | ";" }} | {{ Annotation }} [ pre ] Module ;
Module = pre Path "{{" {{ id {{ id }} Path [ id Path {{ "," Path }} ] ";" }} "}}" ;
Path = id {{ "." id }} ;
Annotation = "@" Path [ "(" [ Pairs ] ")" ] ;
Pairs = Value {{ "," Value }} ;
Value = Expr | Annotation | "{{" [ Value {{ "," Value }} [ "," ] ] "}}" ;
Mod = "public" | "private" | "protected" | "static" | "final" | "abstract" | "native" | "synchronized" | "transient" | "volatile" | "strictfp" | "default" | Annotation | Soft ;
Soft = id ;
TypeDecl = Mods ( "class" id [ TypeParams ] [ "extends" Type ] [ "implements" Types ] Permits Body | "interface" id [ TypeParams ] [ "extends" Types ] Permits Body
  | "enum" id [ "implements" Types ] EnumBody | "@" "interface" id Body | Record ) ;
Mods = {{ HardMod }} ;
HardMod = "public" | "private" | "protected" | "static" | "final" | "abstract" | "strictfp" | Annotation ;
Record = Hard id id [ TypeParams ] "(" [ Params ] ")" [ "implements" Types ] Body ;
Hard = HardMod | Annotation ;
Permits = [ id Types ] ;
Types = Type {{ "," Type }} ;
Body = "{{" {{ Member }} "}}" ;
EnumBody = "{{" [ EnumItem {{ "," EnumItem }} [ "," ] ] [ ";" {{ Member }} ] "}}" ;
EnumItem = {{ Annotation }} id [ Args ] [ Body ] ;
Member = ";" | [ "static" ] Block | MemberMods ( MemberDecl | TypeBodyDecl ) ;
MemberMods = {{ Mod }} ;
TypeBodyDecl = ( "class" | "interface" | "enum" ) id [ TypeParams ] [ "extends" Types ] [ "implements" Types ] Permits ( Body | EnumBody ) | "@" "interface" id Body | id id [ TypeParams ] "(" [ Params ] ")" [ "implements" Types ] Body ;
MemberDecl = [ TypeParams ] ( "void" | Type ) id "(" [ Params ] ")" Dims [ "throws" Types ] ( Block | ";" | "default" Value ";" ) | [ TypeParams ] id "(" [ Params ] ")" [ "throws" Types ] Block | Type Vars ";" ;
Vars = id Dims [ "=" Init ] {{ "," id Dims [ "=" Init ] }} ;
Init = Expr | "{{" [ Init {{ "," Init }} [ "," ] ] "}}" ;
Params = Param {{ "," Param }} ;
Param = {{ "final" | Annotation }} Type [ "..." ] ( id | "this" | id "." "this" ) Dims ;
Dims = {{ {{ Annotation }} "[" "]" }} ;
Type = {{ Annotation }} ( Primitive | id [ TypeArgs ] {{ "." {{ Annotation }} id [ TypeArgs ] }} ) Dims ;
Primitive = "int" | "long" | "boolean" | "char" | "byte" | "short" | "float" | "double" ;
TypeArgs = "<" [ TypeArg {{ "," TypeArg }} ] ">" ;
TypeArg = Type | {{ Annotation }} "?" [ ( "extends" | "super" ) Type ] ;
TypeParams = "<" TypeParam {{ "," TypeParam }} ">" ;
TypeParam = {{ Annotation }} id [ "extends" Type {{ "&" Type }} ] ;
Block = "{{" {{ Stmt }} "}}" ;
Stmt = Block | ";" | {{ "final" | Annotation }} Type Vars ";" | {{ "final" | "abstract" | "static" | Annotation }} TypeBodyDecl | Expr ";" | "if" "(" Expr ")" Stmt [ "else" Stmt ]
  | "while" "(" Expr ")" Stmt | "do" Stmt "while" "(" Expr ")" ";" | "for" "(" ForHead ")" Stmt | "return" [ Expr ] ";" | "break" [ id ] ";" | "continue" [ id ] ";"
  | "throw" Expr ";" | "try" Block ( CatchOne {{ CatchOne }} [ "finally" Block ] | "finally" Block ) | "try" "(" Resources ")" Block {{ CatchOne }} [ "finally" Block ] | "switch" "(" Expr ")" Switch
  | "synchronized" "(" Expr ")" Block | id ":" Stmt | "assert" Expr [ ":" Expr ] ";" | id Expr ";" ;
CatchOne = "catch" "(" {{ "final" | Annotation }} Type {{ "|" Type }} id ")" Block ;
Resources = Resource {{ ";" Resource }} [ ";" ] ;
Resource = {{ "final" | Annotation }} Type id "=" Expr | Expr ;
ForHead = [ Type Vars | Expr {{ "," Expr }} ] ";" [ Expr ] ";" [ Expr {{ "," Expr }} ] | {{ "final" | Annotation }} Type id ":" Expr ;
Switch = "{{" {{ ( "case" Label {{ "," Label }} | "default" ) ( ":" {{ Stmt }} | "->" ( Expr ";" | Block | "throw" Expr ";" ) ) }} "}}" ;
Label = Expr | "default" | Type id [ id Expr ] ;
Expr = Unary {{ Op Unary }} ;
Op = {_BINARY} | {_ASSIGN} | "instanceof" [ "final" ] | "?" Expr ":" | "->" ;
Unary = {{ "!" | "-" | "+" | "~" | "++" | "--" | "(" Type {{ "&" Type }} ")" }} Postfix ;
Postfix = Primary {{ "." ( id | "this" | "class" | "new" | "super" | TypeArgs ( id | "this" | "super" ) ) | "[" Expr "]" | Args | "++" | "--" | "::" ( [ TypeArgs ] id | "new" ) }} ;
Primary = id | num | str | "this" | "super" | "null" | "true" | "false" | "(" Expr ")" | New | Lambda | "switch" "(" Expr ")" Switch | Type "::" | Primitive "." "class" | "void" "." "class" | Type id ;
New = "new" ( Type Args [ Body ] | Type "[" [ Expr ] "]" [ Init ] | Type Init ) ;
Lambda = ( id | "(" [ Params | id {{ "," id }} ] ")" ) "->" ( Expr | Block ) ;
Args = "(" [ Expr {{ "," Expr }} ] ")" ;
"""

CSHARP = f"""
Program = {{ [ "global" ] Using | "extern" id id ";" }} {{ AttributeList }} {{ Decl }} ;
Using = "using" [ "static" ] [ id "=" ] Type ";" ;
Decl = "namespace" Path ( ";" | "{{" {{ Using }} {{ Decl }} "}}" [ ";" ] ) | TypeDecl | TopStmt ;
TopStmt = "await" Expr ";" ;
Path = id {{ "." id }} ;
AttributeList = "[" [ ( id | "return" | "event" ) ":" ] Attribute {{ "," Attribute }} [ "," ] "]" ;
Attribute = Path [ TypeArgs ] [ Args ] ;
Mod = "public" | "private" | "protected" | "internal" | "static" | "readonly" | "sealed" | "abstract" | "virtual" | "override" | "new" | "extern" | "unsafe" | "volatile" | "const" | "ref" | "event" | "fixed" | "implicit" | "explicit" ;
TypeDecl = {{ AttributeList }} {{ Mod | Soft }} ( ( "class" | "struct" | "interface" ) id [ TypeParams ] [ "(" [ Params ] ")" ] [ ":" Base {{ "," Base }} ] Where ( Body | ";" ) | "enum" id [ ":" Type ] EnumBody [ ";" ] | "delegate" Type id [ TypeParams ] "(" [ Params ] ")" Where ";" ) ;
Soft = Mod id | AttributeList id ;
Base = Type [ Args ] ;
Where = {{ id id ":" ( Type | "class" | "struct" | "new" "(" ")" | "class" "?" | "default" ) {{ "," ( Type | "new" "(" ")" ) }} }} ;
TypeParams = "<" {{ AttributeList }} [ "in" | "out" ] id {{ "," [ "in" | "out" ] id }} ">" ;
Body = "{{" {{ Member }} "}}" [ ";" ] ;
EnumBody = "{{" [ {{ AttributeList }} id [ "=" Expr ] {{ "," {{ AttributeList }} id [ "=" Expr ] }} [ "," ] ] "}}" ;
Member = {{ AttributeList }} {{ Mod | id }} ( MemberDecl | TypeDecl ) ;
MemberDecl = Type MemberName [ TypeParams ] "(" [ Params ] ")" Where Code | id "(" [ Params ] ")" [ ":" ( "base" | "this" ) Args ] Code | "~" id "(" ")" Code
  | Type MemberName ( "{{" {{ {{ AttributeList }} {{ Mod }} id Code }} "}}" [ "=" Expr ";" ] | "=>" Expr ";" ) | Type "this" "[" Params "]" "{{" {{ {{ Mod }} id Code }} "}}" | Type "operator" AnyOp "(" Params ")" Code | "operator" Type "(" Params ")" Code | Type Vars ";" ;
AnyOp = "+" | "-" | "*" | "/" | "%" | "==" | "!=" | "<" | ">" | "<=" | ">" "=" | "!" | "~" | "&" | "|" | "^" | "++" | "--" | "true" | "false" ;
MemberName = id {{ "." id }} | id TypeArgs "." id ;
Code = Block | "=>" Expr ";" | ";" ;
Vars = id [ "=" Init ] {{ "," id [ "=" Init ] }} ;
Init = Expr | "{{" [ Init {{ "," Init }} [ "," ] ] "}}" ;
Params = Param {{ "," Param }} ;
Param = {{ AttributeList }} {{ "ref" | "out" | "in" | "params" | "this" | "readonly" }} Type id [ "=" Expr ] ;
Type = ( Primitive | id [ TypeArgs ] {{ ( "." | "::" ) id [ TypeArgs ] }} | "(" Type [ id ] {{ "," Type [ id ] }} ")" ) {{ "?" | "*" | "[" {{ "," }} "]" }} ;
Primitive = "int" | "long" | "bool" | "char" | "byte" | "short" | "float" | "double" | "string" | "object" | "decimal" | "uint" | "ulong" | "ushort" | "sbyte" | "void" ;
TypeArgs = "<" [ Type ] {{ "," [ Type ] }} ">" ;
Block = "{{" {{ Stmt }} "}}" ;
Stmt = Block | ";" | [ "const" | "ref" | "using" | "await" "using" ] Type Vars ";" | Expr ";" | "if" "(" Expr ")" Stmt [ "else" Stmt ] | "while" "(" Expr ")" Stmt | "do" Stmt "while" "(" Expr ")" ";"
  | "for" "(" [ Type Vars | Expr ] ";" [ Expr ] ";" [ Expr {{ "," Expr }} ] ")" Stmt | [ id ] "foreach" "(" Type id "in" Expr ")" Stmt | "foreach" "(" id Tuple "in" Expr ")" Stmt
  | "return" [ Expr ] ";" | "break" ";" | "continue" ";" | "goto" ( id | "case" Expr | "default" ) ";" | "throw" [ Expr ] ";"
  | "try" Block ( CatchOne {{ CatchOne }} [ "finally" Block ] | "finally" Block ) | "switch" "(" Expr ")" "{{" {{ ( "case" Pattern [ id Expr ] | "default" ) ":" {{ Stmt }} }} "}}"
  | ( "lock" | "using" | "fixed" ) "(" ( Expr | Type Vars ) ")" Stmt | ( "checked" | "unchecked" | "unsafe" ) Block | id ":" Stmt | id ( "return" Expr | "break" ) ";" | {{ "static" | id }} Type id [ TypeParams ] "(" [ Params ] ")" Where Code | id Tuple "=" Expr ";" ;
CatchOne = "catch" [ "(" Type [ id ] ")" ] [ id "(" Expr ")" ] Block ;
Tuple = "(" id {{ "," id }} ")" ;
Pattern = Expr | Type id | "null" | ( "<" | ">" | "<=" ) Expr | "{{" [ id ":" Pattern {{ "," id ":" Pattern }} ] "}}" | id Pattern ;
Expr = Unary {{ Op Unary }} ;
Op = {_BINARY} | {_ASSIGN} | "??" | "??=" | "?" Expr ":" | "=>" | "is" Pattern Tail | "as" Type Tail | ".." ;
Tail = Op Unary | ")" | ";" | "," | "]" | "}}" | ":" | "?" ;
Unary = {{ "!" | "-" | "+" | "~" | "++" | "--" | "&" | "*" | "^" | ".." | "(" Type ")" | "await" | "ref" | "out" | "in" | "throw" }} Postfix ;
Postfix = Primary {{ ( "." | "?." | "->" ) id [ TypeArgs ] | "?" "[" Expr "]" | "[" Expr {{ "," Expr }} "]" | Args | "++" | "--" | "!" | id "{{" {{ Pattern "=>" Expr [ "," ] }} "}}" | "switch" "{{" [ Pattern [ id Expr ] "=>" Expr {{ "," Pattern [ id Expr ] "=>" Expr }} [ "," ] ] "}}" | "with" Init }} ;
Primary = id [ TypeArgs ] | num | str | "this" | "base" | "null" | "true" | "false" | "(" Expr {{ "," Expr }} ")" | New | Lambda | Primitive "." id | ( "typeof" | "sizeof" | "default" | "checked" | "unchecked" ) [ "(" ( Type | Expr ) ")" ] | "delegate" [ "(" [ Params ] ")" ] Block | "stackalloc" Type "[" Expr "]" | "[" [ Expr {{ "," Expr }} ] "]" | Type id | id Expr ;
New = "new" ( Type ( Args [ Init ] | Init | "[" Expr "]" [ Init ] ) | "{{" [ id [ "=" Expr ] {{ "," id [ "=" Expr ] }} [ "," ] ] "}}" | "[" "]" Init | Args ) ;
Lambda = [ "static" ] [ id ] ( id | "(" [ Params | id {{ "," id }} ] ")" ) "=>" ( Expr | Block ) ;
Args = "(" [ Arg {{ "," Arg }} ] ")" ;
Arg = [ id ":" ] [ "ref" | "out" | "in" ] ( Expr | Type id ) ;
"""

PYTHON = """
Program = { Nl } { Stmt } ;
Nl = "NL" ;
Stmt = Line | Compound ;
Line = Small { ";" Small } [ ";" ] End ;
End = NL | OUT ;
Suite = ":" ( IN { Stmt } | Line ) ;
Small = Exprs | Exprs { "=" ( Exprs | Yield ) } | Target ":" Expr [ "=" Exprs ] | Exprs Aug ( Exprs | Yield ) | "pass" | "break" | "continue" | "return" [ Exprs ] | "raise" [ Expr [ "from" Expr ] ] | "global" Names | "nonlocal" Names | "del" Exprs | "assert" Expr [ "," Expr ] | Import | Yield | id id "=" Expr ;
Target = id | Postfix ;
Aug = "+=" | "-=" | "*=" | "/=" | "//=" | "%=" | "**=" | "&=" | "|=" | "^=" | "<<=" | ">>=" | "@=" ;
Names = id { "," id } ;
Import = "import" Path [ "as" id ] { "," Path [ "as" id ] } | "from" ( { "." | "..." } Path | "." { "." } | "..." ) "import" ( "*" | Aliases | "(" Aliases [ "," ] ")" ) ;
Aliases = id [ "as" id ] { "," id [ "as" id ] } ;
Path = id { "." id } ;
Compound = "if" Named Suite { "elif" Named Suite } [ "else" Suite ] | "while" Named Suite [ "else" Suite ] | [ "async" ] "for" Exprs "in" Exprs Suite [ "else" Suite ]
  | "try" Suite { "except" [ "*" ] [ Expr [ "as" id ] ] Suite } [ "else" Suite ] [ "finally" Suite ] | [ "async" ] "with" WithItems Suite | { Decorator } ( Def | Class ) | "match" Exprs ":" IN { "match" Exprs [ "if" Expr ] Suite } ;
WithItems = WithItem { "," WithItem } | "(" WithItem { "," WithItem } [ "," ] ")" ;
WithItem = Expr [ "as" Expr ] ;
Decorator = "@" Expr NL ;
Def = [ "async" ] "def" id [ TypeParams ] "(" [ Params ] ")" [ "->" Expr ] Suite ;
TypeParams = "[" id [ ":" Expr ] { "," id } "]" ;
Params = Param { "," Param } [ "," ] ;
Param = [ "*" | "**" ] id [ ":" Expr ] [ "=" Expr ] | "*" | "/" ;
Class = "class" id [ TypeParams ] [ Args ] Suite ;
Yield = "yield" [ "from" Expr | Exprs ] ;
Exprs = Item { "," Item } [ "," ] ;
Item = [ "*" ] Named ;
Named = Expr | id ":=" Expr ;
Expr = Unary { Op Unary } | "lambda" [ LParams ] ":" Expr | Expr "if" Expr "else" Expr ;
LParams = LParam { "," LParam } [ "," ] ;
LParam = [ "*" | "**" ] id [ "=" Expr ] | "*" | "/" ;
Op = "+" | "-" | "*" | "/" | "//" | "%" | "@" | "**" | "&" | "|" | "^" | "<<" | ">>" | "<" | ">" | "<=" | ">=" | "==" | "!=" | "in" | "not" "in" | "is" [ "not" ] | "and" | "or" ;
Unary = { "not" | "-" | "+" | "~" | "await" } Postfix ;
Postfix = Primary { "." id | "[" Slices "]" | Args } ;
Slices = Slice { "," Slice } [ "," ] ;
Slice = [ Item ] [ ":" [ Expr ] [ ":" [ Expr ] ] ] ;
Primary = id | num | str { str } | "None" | "True" | "False" | "..." | "(" [ Exprs | Yield | Item Comp ] ")" | "[" [ Exprs | Item Comp ] "]" | "{" [ Pairs | Exprs | Item Comp | Expr ":" Expr Comp ] "}" ;
Pairs = Pair { "," Pair } [ "," ] ;
Pair = Expr ":" Expr | "**" Expr ;
Comp = [ "async" ] "for" Exprs "in" Expr { "if" Expr | [ "async" ] "for" Exprs "in" Expr } ;
Args = "(" [ Arg { "," Arg } [ "," ] ] ")" ;
Arg = [ id "=" | "*" | "**" ] Named [ Comp ] ;
"""

GROOVY = f"""
Program = [ "package" Path Semi ] {{ Stmt }} ;
Semi = ";" ;
Path = id {{ "." ( id | "*" ) }} ;
Stmt = Block | ";" | "import" [ "static" ] Path [ "as" id ] Semi | Simple Semi | "if" "(" Expr ")" Stmt [ "else" Stmt ] | "while" "(" Expr ")" Stmt | "for" "(" ForHead ")" Stmt
  | "try" Block {{ "catch" "(" [ Type ] {{ "|" Type }} id ")" Block }} [ "finally" Block ] | "switch" "(" Expr ")" "{{" {{ ( "case" Expr | "default" ) ":" {{ Stmt }} }} "}}" | Decl ;
Simple = Expr | "return" [ Expr ] | "throw" Expr | "break" | "continue" | "assert" Expr [ ":" Expr ] | Command | {{ Mod }} ( "def" | Type ) id [ "=" Expr ] {{ "," id [ "=" Expr ] }} | "def" "(" id {{ "," id }} ")" "=" Expr ;
Command = Postfix CommandArg {{ "," CommandArg }} [ Closure ] | Postfix Command ;
CommandArg = [ id ":" | str ":" ] Expr ;
Mod = "public" | "private" | "protected" | "static" | "final" | "abstract" | Annotation ;
Annotation = "@" Path [ Args ] ;
Decl = {{ Mod }} ( ( "class" | "interface" | "enum" | "trait" ) id [ TypeArgs ] [ "extends" Type ] [ "implements" Type {{ "," Type }} ] Block | ( "def" | "void" | Type ) ( id | str ) "(" [ Params ] ")" [ "throws" Type ] Block | id "(" [ Params ] ")" Block ) ;
Params = Param {{ "," Param }} ;
Param = [ "final" ] [ "def" | Type ] id [ "=" Expr ] ;
ForHead = [ Simple ] ";" [ Expr ] ";" [ Expr ] | [ "def" | Type ] id ( "in" | ":" ) Expr ;
Type = ( id [ TypeArgs ] {{ "." id }} | "int" | "long" | "boolean" | "char" | "byte" | "short" | "float" | "double" | "void" ) {{ "[" "]" }} ;
TypeArgs = "<" [ TypeArg {{ "," TypeArg }} ] ">" ;
TypeArg = Type | "?" [ "extends" Type ] ;
Block = "{{" {{ Stmt }} "}}" ;
Closure = "{{" [ [ Params ] "->" ] {{ Stmt }} "}}" ;
Expr = Unary {{ Op Unary }} ;
Op = {_BINARY} | {_ASSIGN} | ">=" | "**" | "=~" | "==~" | "<=>" | "===" | "?:" | "?" Expr ":" | "in" | "as" | "instanceof" | ".." | "..<" | "->" ;
Unary = {{ "!" | "-" | "+" | "~" | "++" | "--" | "*" | "(" Type ")" }} Postfix ;
Postfix = Primary {{ ( "." | "?." | "*." | ".&" | "::" ) ( id | str | "class" | "@" id | "new" | "this" | "default" ) | "[" [ Expr {{ "," Expr }} ] "]" | Args | Closure | "++" | "--" }} ;
Primary = id | num | str | re | "this" | "super" | "null" | "true" | "false" | "(" Expr ")" | List | Closure | "new" Type ( Args | "[" Expr "]" ) [ Closure ] ;
List = "[" [ Entry {{ "," Entry }} [ "," ] ] "]" | "[" ":" "]" ;
Entry = [ ( id | str | num | "(" Expr ")" | "class" | "default" ) ":" ] Expr | "*" ":" Expr ;
Args = "(" [ Entry {{ "," Entry }} [ "," ] ] ")" ;
"""

JSON = """
Program = Value ;
Value = Object | Array | str | num | "true" | "false" | "null" ;
Object = "{" [ key ":" Value { "," key ":" Value } ] "}" ;
Array = "[" [ Value { "," Value } ] "]" ;
"""

GRAMMARS = {"javascript": SCRIPT, "typescript": SCRIPT + TYPED, "java": JAVA, "csharp": CSHARP, "groovy": GROOVY, "python": PYTHON, "json": JSON}
#: Productions whose ends and starts a line end may part, where a language ends statements so.
LINE_ENDS = {"javascript": ("Simple", "Stmt"), "typescript": ("Simple", "Stmt"), "groovy": ("Simple", "Stmt")}


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    return Grammar(GRAMMARS[language])


@lru_cache(maxsize=None)
def permitted(language: str) -> frozenset[tuple[str, str, int]]:
    """Triples of two adjacent token classes and whether a line ends between them."""
    g = grammar(language)
    out = {(a, b, nl) for a, b in g.adjacent("Program") for nl in (0, 1)}
    if language in LINE_ENDS:
        end, start = LINE_ENDS[language]
        ends = g.last[end] | ({"}", ")", "]", "id"} if language == "typescript" else set())
        starts = g.first[start] | {"EOF", "}", "case", "default"} | (g.first["Member"] | g.first["TypeMember"] if language == "typescript" else g.first.get("Member", set()))
        out |= {(a, b, 1) for a in ends for b in starts}
        out |= {(a, "}", 0) for a in ends}
    if language == "python":
        out |= {("BOF", b, 0) for b in ("EOF", "NL")} | {(a, "EOF", nl) for a in ("NL", "OUT") for nl in (0, 1)}
        out |= {(a, b, nl) for a in ("NL", "IN", "OUT") for b in ("NL", "OUT") for nl in (0, 1) if (a, b) != ("IN", "OUT")}
    return frozenset(out)


@lru_cache(maxsize=None)
def productions(language: str) -> frozenset[tuple[str, str, str]]:
    """Triples of a word, the bracket it opens, and what may follow that bracket's end.

    They come from alternatives in which the word is followed by a bracketed part or by a block, and then by more.
    """
    g = grammar(language)
    out: set[tuple[str, str, str]] = set()
    for alts in g.rules.values():
        for alt in alts:
            for k, word in enumerate(alt):
                if not word.isalpha() or word in g.rules or word in ("id", "pre", "mid", "str", "cid") or k + 1 == len(alt):
                    continue
                if alt[k + 1] == "(" and ")" in alt[k + 2 :]:
                    end, bracket = alt.index(")", k + 2), "("
                elif alt[k + 1] in ("Block", "Stmt") and word in ("try", "do"):
                    end, bracket = k + 1, "{"
                else:
                    continue
                for s in alt[end + 1 :]:
                    out |= {(word, bracket, x) for x in (g.first[s] if s in g.rules else {s})}
                    if s not in g.nullable:
                        break
                else:
                    out.add((word, bracket, ""))  # what follows is open
    loose = {(w, b) for w, b, x in out if not x}
    return frozenset(t for t in out if (t[0], t[1]) not in loose)


def pair_rows() -> list[tuple[int]]:
    """The permitted pairs of all languages as single numbers, see ``pair_number``."""
    number = classes()
    return sorted({(int(pair_number(CODES[lang], number[a], number[b], nl)),) for lang in GRAMMARS for a, b, nl in permitted(lang) if a in number and b in number})


def pair_number(language, before, after, newline):
    """One number for a pair; works on numbers and numpy arrays."""
    return ((language * 512 + before) * 512 + after) * 2 + newline
