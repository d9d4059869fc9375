"""Grammars of Python 3.12/3.13 and of current JavaScript, JSX, TypeScript and TSX, for
:mod:`lodestone.llm.derivatives`. One JavaScript text serves four variants: lines marked ``#ts`` or
``#jsx`` hold only where those are on, lines marked ``#nots`` only where TypeScript is off."""

from __future__ import annotations

PYTHON = r"""
File = ( NEWLINE | Stmt )* ;
Stmt = Simple | Compound ;
Simple = Small ( ';' Small )* ';'? NEWLINE ;
Small = ExprStmt | 'pass' | 'break' | 'continue' | 'del' Targets | 'return' StarExprs? | Raise
      | ( 'global' | 'nonlocal' ) Nm ( ',' Nm )* | Import | 'assert' Expr ( ',' Expr )? | 'type' Nm TypeParams? '=' Expr ;
Raise = 'raise' ( Expr ( 'from' Expr )? )? ;
Nm = NAME | 'match' | 'case' | 'type' | '_' ;
Dotted = Nm ( '.' Nm )* ;
Import = 'import' Dotted ( 'as' Nm )? ( ',' Dotted ( 'as' Nm )? )*
       | 'from' ( ( '.' | '...' )* Dotted | ( '.' | '...' )+ ) 'import' ( '*' | FromNames | '(' FromNames ','? ')' ) ;
FromNames = Nm ( 'as' Nm )? ( ',' Nm ( 'as' Nm )? )* ;
ExprStmt = StarExprs ( ':' Expr ( '=' Value )? | AUG Value | ( '=' Value )* ) | Yield ( '=' Value )* ;
Value = Yield | StarExprs ;
Yield = 'yield' ( 'from' Expr | StarExprs? ) ;
StarExprs = StarExpr ( ',' StarExpr )* ','? ;
StarExpr = Expr | '*' Or ;
Targets = Target ( ',' Target )* ','? ;
Target = '*'? Primary ;
Block = NEWLINE INDENT ( Stmt | NEWLINE )+ DEDENT | Simple ;
Compound = If | While | For | With | Try | Def | Class | Match | Decorated | 'async' ( For | With | Def ) ;
Decorated = ( '@' Named NEWLINE )+ ( 'async'? Def | Class ) ;
If = 'if' Named ':' Block ( 'elif' Named ':' Block )* Else? ;
Else = 'else' ':' Block ;
While = 'while' Named ':' Block Else? ;
For = 'for' Targets 'in' StarExprs ':' Block Else? ;
With = 'with' ( WithItem ( ',' WithItem )* | '(' WithItem ( ',' WithItem )* ','? ')' ) ':' Block ;
WithItem = Expr ( 'as' Target )? ;
Try = 'try' ':' Block ( ( 'except' '*'? ( ExceptOf ( 'as' Nm )? )? ':' Block )+ Else? Finally? | Finally ) ;
ExceptOf = Expr ;
Finally = 'finally' ':' Block ;
Def = 'def' Nm TypeParams? '(' Params? ')' ( '->' StarExprs )? ':' Block ;
Class = 'class' Nm TypeParams? ( '(' Args? ')' )? ':' Block ;
TypeParams = '[' TypeParam ( ',' TypeParam )* ','? ']' ;
TypeParam = ( '*' | '**' )? Nm ( ':' Expr )? ( '=' Expr )? ;
Par = Nm ( ':' StarExpr )? ;
ParD = Par '=' Expr ;
Params = Par ( ',' ParamsP? )? | ParamsD ;
ParamsP = '/' ( ',' Params2? )? | Par ( ',' ParamsP? )? | ParamsD ;
Params2 = Par ( ',' Params2? )? | ParamsD2 ;
ParamsD = ParD ( ',' ParamsDP? )? | ParamsStar ;
ParamsDP = '/' ( ',' ParamsD2? )? | ParamsD ;
ParamsD2 = ParD ( ',' ParamsD2? )? | ParamsStar ;
ParamsStar = '*' Par ( ',' ParamsAfter? )? | '*' ',' ParamsAfter | '**' Par ','? ;
ParamsAfter = ( Par | ParD ) ( ',' ParamsAfter? )? | '**' Par ','? ;
LPar = Nm ( '=' Expr )? ;
LParams = LPar ( ',' LParams? )? | '/' ( ',' LParams? )? | '*' LPar? ( ',' LParams? )? | '**' Nm ','? ;
Expr = Or ( 'if' Or 'else' Expr )? | 'lambda' LParams? ':' Expr ;
Named = Expr | Nm ':=' Expr ;
Or = And ( 'or' And )* ;
And = Inv ( 'and' Inv )* ;
Inv = 'not'* Cmp ;
Cmp = Arith ( CmpOp Arith )* ;
CmpOp = CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
Arith = Un ( ArOp Un )* ;
ArOp = AROP | '*' | '-' | '+' | '@' | '/' ;
Un = ( '+' | '-' | '~' )* Power ;
Power = 'await'? Primary ( '**' Un )? ;
Primary = Atom ( '.' Nm | '(' Args? ')' | '[' Slices ']' )* ;
Slices = ( Slice | '*' Or ) ( ',' ( Slice | '*' Or ) )* ','? ;
Slice = Named | Expr? ':' Expr? ( ':' Expr? )? ;
Atom = Nm | NUM | STR+ | '...' | 'None' | 'True' | 'False'
     | '(' ( Yield | NamedStar ( Comp | ( ',' NamedStar )* ','? ) )? ')'
     | '[' ( NamedStar ( Comp | ( ',' NamedStar )* ','? ) )? ']'
     | '{' ( NamedStar ( Comp | ( ',' NamedStar )* ','? ) | DictItem ( Comp | ( ',' DictItem )* ','? ) )? '}' ;
NamedStar = Named | '*' Or ;
DictItem = Expr ':' Expr | '**' Or ;
Comp = ( 'async'? 'for' Targets 'in' Or ( 'if' CondNoIf )* )+ ;
CondNoIf = Or | Nm ':=' Or ;
Args = ArgP ( ',' Args? )? | Named Comp | ArgsK ;
ArgP = Named | '*' Expr ;
ArgsK = ArgK ( ',' ArgsKS? )? ;
ArgsKS = ( ArgK | '*' Expr ) ( ',' ArgsKS? )? ;
ArgK = Nm '=' Expr | '**' Expr ;
Match = 'match' Subject ':' NEWLINE INDENT Case+ DEDENT ;
Subject = NamedStar ( ',' NamedStar )* ','? ;
Case = 'case' Patterns ( 'if' Named )? ':' Block ;
Patterns = MaybeStar ( ',' MaybeStar )* ','? ;
MaybeStar = '*' Nm | AsPattern ;
AsPattern = OrPattern ( 'as' Nm )? ;
OrPattern = Closed ( '|' Closed )* ;
Closed = Number | STR+ | 'None' | 'True' | 'False' | Dotted ( '(' ( ClassArg ( ',' ClassArg )* ','? )? ')' )?
       | '(' ( MaybeStar ( ',' MaybeStar )* ','? )? ')' | '[' ( MaybeStar ( ',' MaybeStar )* ','? )? ']'
       | '{' ( MapItem ( ',' MapItem )* ','? )? '}' ;
Number = '-'? NUM ( ( '+' | '-' ) NUM )? ;
ClassArg = AsPattern | Nm '=' AsPattern ;
MapItem = ( Number | STR+ | 'None' | 'True' | 'False' | Dotted ) ':' AsPattern | '**' Nm ;
"""

_JS = r"""
Module = Item* ;
Item = Import | Export | Stmt ;
Import = 'import' ( STR Attrs? ';' | ImpClause 'from' STR Attrs? ';' ) ;
Import2 = 'import' 'type' ImpClause 'from' STR ';' | 'import' 'type'? Id '=' ( 'require' '(' STR ')' | IdPath ) ';' ;        #ts
Attrs = ( 'with' | 'assert' ) Object ;
ImpClause = Id ( ',' ( NsImp | NamedSpecs ) )? | NsImp | NamedSpecs ;
NsImp = '*' 'as' Id ;
NamedSpecs = '{' ( Spec ( ',' Spec )* ','? )? '}' ;
Spec = ( IdName | STR ) ( 'as' ( IdName | STR ) )? ;
Spec2 = 'type' ( IdName | STR ) ( 'as' ( IdName | STR ) )? ;                                                                  #ts
Export = Decorator* 'export' ( '*' ( 'as' ( IdName | STR ) )? 'from' STR Attrs? ';' | NamedSpecs ( 'from' STR Attrs? )? ';'
       | 'default' ( Func | Class | !{'function' 'class' '@' 'interface'} Assign ';' ) | Decl ) ;
Export2 = 'export' ( 'type' NamedSpecs ( 'from' STR )? ';' | 'type' '*' ( 'as' IdName )? 'from' STR ';' | '=' Expr ';' | 'as' 'namespace' Id ';' | 'import' Id '=' IdPath ';'
       | 'default' ( Interface | 'abstract' Class ) ) ;                                                                      #ts
Decl = Func | Class | VarDecl ';' ;
Decl2 = Interface | TypeAlias | Enum | Namespace | 'declare' Declared | 'abstract' Class ;                                   #ts
Declared = Decl | 'abstract'? Class | 'global' Block ;                                                                       #ts
Id = NAME | CONTEXT | 'async' | 'of' | 'get' | 'set' | 'static' | 'as' | 'from' | 'type' | 'let' | 'await' | 'yield' | 'require' | 'abstract' | 'declare' | 'namespace' | 'global'
   | 'interface' | 'enum' | 'readonly' | 'keyof' | 'unique' | 'infer' | 'is' | 'asserts' | 'satisfies' | 'implements' | 'accessor' | 'constructor' | 'assert' | 'out' | 'override' ;
IdName = Id | 'this' | 'super' | 'null' | 'true' | 'false' | 'import' | 'export' | 'default' | 'function' | 'class' | 'extends' | 'new' | 'typeof' | 'void' | 'delete' | 'in' | 'instanceof'
   | 'if' | 'else' | 'for' | 'while' | 'do' | 'continue' | 'break' | 'return' | 'switch' | 'case' | 'throw' | 'try' | 'catch' | 'finally' | 'debugger' | 'var' | 'const' | 'with' ;
IdPath = Id ( '.' IdName )* ;
Block = '{' StmtItem* '}' ;
StmtItem = Stmt ;
Stmt = Block | ';' | Decl | !{'{' 'function' 'class' '@' 'import(' } Expr ';' | If | For | While | Do | Jump | Switch | Try | Id ':' Stmt ;
If = 'if' '(' Expr ')' Stmt ( 'else' Stmt )? ;
While = 'while' '(' Expr ')' Stmt ;
Do = 'do' Stmt 'while' '(' Expr ')' ';'? ;
Jump = ( 'continue' | 'break' ) Id? ';' | 'return' Expr? ';' | 'throw' Expr ';' | 'debugger' ';' ;
For = 'for' 'await'? '(' ForHead ')' Stmt ;
ForHead = VarKw Binding TypeNote? ( 'of' Assign | 'in' Expr ) | ( VarDecl | Expr )? ';' Expr? ';' Expr? | Lhs ( 'of' Assign | 'in' Expr ) ;
VarKw = 'var' | 'let' | 'const' ;
VarDecl = VarKw Var ( ',' Var )* ;
Var = Binding '!'? TypeNote? ( '=' Assign )? ;
TypeNote = NEVER ;                                                                                                          #nots
TypeNote = ':' Type ;                                                                                                       #ts
Switch = 'switch' '(' Expr ')' '{' ( ( 'case' Expr | 'default' ) ':' StmtItem* )* '}' ;
Try = 'try' Block ( 'catch' ( '(' Binding TypeNote? ')' )? Block ( 'finally' Block )? | 'finally' Block ) ;
Binding = Id | ObjPattern | ArrPattern ;
ObjPattern = '{' ( PropPattern ( ',' PropPattern )* ','? )? '}' ;
PropPattern = PropName ':' Binding Init? | Id Init? | '...' Id ;
ArrPattern = '[' ( '...'? Binding Init? )? ( ',' ( '...'? Binding Init? )? )* ']' ;
Init = '=' Assign ;
Func = 'async'? 'function' '*'? Id? Signature FuncEnd ;
FuncEnd = Block ;                                                                                                           #nots
FuncEnd = Block | ';' ;                                                                                                     #ts
Signature = Params ;                                                                                                        #nots
Signature = TypeParams? Params ReturnType? ;                                                                                #ts
ReturnType = ':' ( 'asserts'? ( Id | 'this' ) ( 'is' Type )? | Type ) ;                                                      #ts
Params = '(' ( Param ( ',' Param )* ','? )? ')' ;
Param = Decorator* '...'? Binding Init? ;                                                                                   #nots
Param = Decorator* ( 'CONTEXT' | 'readonly' | 'override' )* '...'? ( Binding | 'this' ) '?'? TypeNote? Init? ;               #ts
Class = Decorator* 'class' Id? Heritage '{' Member* '}' ;
Heritage = ( 'extends' Lhs )? ;                                                                                             #nots
Heritage = TypeParams? ( 'extends' Lhs TypeArgs? )? ( 'implements' TypeRef ( ',' TypeRef )* )? ;                             #ts
Decorator = '@' ( IdPath Args? | '(' Expr ')' ) ;
Member = ';' | 'static' Block | Decorator* Mod* ( PropName TypeMark ( '=' Assign )? ';' | MethodHead MethodEnd ) ;
Member2 = Mod* '[' Id ':' Type ']' TypeNote ';' ;                                                                           #ts
TypeMark = NEVER? ;                                                                                                         #nots
TypeMark = ( '?' | '!' )? TypeNote? ;                                                                                       #ts
Mod = 'static' | 'accessor' ;                                                                                               #nots
Mod = 'static' | 'accessor' | CONTEXT | 'readonly' | 'abstract' | 'override' | 'declare' ;                                   #ts
MethodEnd = Block ;                                                                                                         #nots
MethodEnd = Block | ';' ;                                                                                                   #ts
MethodHead = ( 'async'? '*'? | 'get' | 'set' ) PropName Signature ;                                                         #nots
MethodHead = ( 'async'? '*'? | 'get' | 'set' ) PropName '?'? Signature ;                                                    #ts
PropName = IdName | STR | NUM | PRIVATE | '[' Assign ']' ;
Expr = Assign ( ',' Assign )* ;
Assign = Arrow | 'yield' '*'? Assign | Cond ( ASSIGN Assign | '=' Assign | '>' '>' '=' Assign | '>' '>' '>' '=' Assign | '>' '>=' Assign | '>' '>' '>=' Assign )? ;
Arrow = 'async'? ( Id | Signature ) '=>' ( Block | !{'{'} Assign ) ;
Cond = Bin ( '?' Assign ':' Assign )? ;
Bin = Unary ( BinOp Unary | CastOp )* ;
BinOp = OP | '+' | '-' | '*' | '/' | '<' | '>' | '>=' | '>' '>' | '>' '>' '>' | 'in' | 'instanceof' | '|' | '&' ;
CastOp = NEVER ;                                                                                                            #nots
CastOp = ( 'as' | 'satisfies' ) Type ;                                                                                      #ts
Unary = ( '!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | INC | 'await' )* Postfix ;
Unary2 = '<' Type '>' Unary ;                                                                                               #ts
Postfix = Lhs INC? ;
Lhs = 'new'* Primary Suffix* ;
Suffix = '.' ( IdName | PRIVATE ) | '?.' ( IdName | PRIVATE | '[' Expr ']' | Args | Template ) | '[' Expr ']' | Args | Template ;
Suffix2 = '!' | TypeArgs | '?.' TypeArgs Args ;                                                                              #ts
Args = '(' ( Arg ( ',' Arg )* ','? )? ')' ;
Arg = '...'? Assign ;
Primary = Id | 'this' | 'super' | NUM | STR | 'null' | 'true' | 'false' | REGEX | Template | '(' Expr ')' | Array | Object | Func1 | Class
        | 'import' ( '(' Assign ( ',' Assign )? ','? ')' | '.' Id ) | 'new' '.' Id | PRIVATE 'in' Unary ;
Primary2 = Jsx ;                                                                                                            #jsx
Func1 = 'async'? 'function' '*'? Id? Signature Block ;
Template = TPL | TPL_HEAD Expr ( TPL_MID Expr )* TPL_TAIL ;
Array = '[' Arg? ( ',' Arg? )* ']' ;
Object = '{' ( Prop ( ',' Prop )* ','? )? '}' ;
Prop = PropName ':' Assign | Id Init? | '...' Assign | MethodHead Block ;
Type = Union ( 'extends' Union '?' Type ':' Type )? | FuncType ;                                                             #ts
FuncType = 'abstract'? 'new'? TypeParams? Params '=>' ( 'asserts'? ( Id | 'this' ) 'is' Type | Type ) ;                       #ts
Union = '|'? Inter ( '|' Inter )* ;                                                                                         #ts
Inter = '&'? TypeOp ( '&' TypeOp )* ;                                                                                       #ts
TypeOp = ( 'keyof' | 'unique' | 'readonly' | 'infer' )* TypePost ;                                                          #ts
TypePost = TypePrim ( '[' Type? ']' )* ;                                                                                    #ts
TypePrim = '(' Type ')' | TypeRef | 'this' | 'void' | 'null' | 'true' | 'false' | STR | '-'? NUM | TPL | TPL_HEAD Type ( TPL_MID Type )* TPL_TAIL
         | ObjType | TupleType | 'typeof' ( 'import' '(' STR ')' | IdPath ) TypeArgs? | 'import' '(' STR ')' ( '.' IdName )* TypeArgs? ;    #ts
TypeRef = Id ( '.' IdName )* TypeArgs? ;                                                                                    #ts
TypeArgs = '<' Type ( ',' Type )* '>' ;                                                                                     #ts
TupleType = '[' ( TupleItem ( ',' TupleItem )* ','? )? ']' ;                                                                #ts
TupleItem = '...'? ( Id '?'? ':' )? Type '?'? ;                                                                             #ts
ObjType = '{' ( TypeMember ( ';' | ',' ) )* TypeMember? '}' | '{' Mapped '}' ;                                               #ts
TypeMember = ( 'readonly' | 'get' | 'set' )? PropName '?'? ( TypeNote? | Signature ) | 'new'? Signature | 'readonly'? '[' Id ':' Type ']' TypeNote ;   #ts
Mapped = ( ( '+' | '-' )? 'readonly' )? '[' Id 'in' Type ( 'as' Type )? ']' ( ( '+' | '-' )? '?' )? TypeNote? ';'? ;           #ts
TypeParams = '<' TypeParam ( ',' TypeParam )* ','? '>' ;                                                                    #ts
TypeParam = ( 'const' | 'in' | 'out' )* Id ( 'extends' Type )? ( '=' Type )? ;                                               #ts
Interface = 'interface' Id TypeParams? ( 'extends' TypeRef ( ',' TypeRef )* )? ObjType ;                                     #ts
TypeAlias = 'type' Id TypeParams? '=' Type ';' ;                                                                            #ts
Enum = 'const'? 'enum' Id '{' ( PropName Init? ( ',' PropName Init? )* ','? )? '}' ;                                         #ts
Namespace = ( 'namespace' | CONTEXT ) ( IdPath | STR ) ( '{' Item* '}' | ';' ) ;                                             #ts
Jsx = JSX_OPEN ( JName JAttr* ( '/' '>' | '>' JChild* JSX_OPEN '/' JName '>' ) | '>' JChild* JSX_OPEN '/' '>' ) ;            #jsx
JName = JSX_ID ( ( '.' | ':' ) JSX_ID )* ;                                                                                  #jsx
JAttr = JSX_ID ( ':' JSX_ID )? ( '=' ( JSX_STR | '{' Assign '}' | Jsx ) )? | '{' '...' Assign '}' ;                           #jsx
JChild = JSX_TEXT | '{' ( '...'? Expr )? '}' | Jsx ;                                                                        #jsx
"""

#: A rule and its continuation that only one variant has: the second is one more alternative of the first.
_MORE = ("Import", "Export", "Decl", "Member", "Unary", "Suffix", "Primary", "Spec")


#: In a scan that does not know where markup begins, its parts are spelled with ordinary tokens.
_LOOSE = {
    "JSX_OPEN": "'<'",
    "JSX_ID": "( IdName ( '-' IdName )* )",
    "JSX_STR": "STR",
    "JSX_TEXT": "( IdName | CONTEXT | NUM | STR | OP | ASSIGN | INC | REGEX | PRIVATE | '...' | '=>' | '>=' | '?.' | '+' | '-' | '*' | '/' | '&' | '|' | '~' | '!' | '?' | ':' | ';' | ',' | '.' | '=' | '(' | ')' | '[' | ']' | '@' )",
}


def javascript(ts: bool, jsx: bool, loose: bool = False) -> str:
    """The grammar text of one variant."""
    on = {"ts": ts, "jsx": jsx, "nots": not ts}
    part, out = [], []
    for line in _JS.split("\n"):
        body, _, mark = line.partition("#")
        part.append(body.rstrip())
        if part[-1].endswith(";"):
            if not mark.strip() or on[mark.strip()]:
                out.append(" ".join(part))
            part = []
    if ts and jsx:  # `<T>x` casts do not exist in TSX
        out = [x for x in out if not x.startswith("Unary2 ")]
    text = "\n" + "\n".join(out)
    for name in _MORE:
        if f"\n{name}2 = " in text:
            text = text.replace(f"\n{name} = ", f"\n{name} = {name}2 | ", 1)
    if loose:
        for name, tokens in _LOOSE.items():
            text = text.replace(f" {name} ", f" {tokens} ").replace(f" {name} ", f" {tokens} ")
    return text
